"""Each pipeline stage against a plain version of its decision, on what its predecessor kept."""

import re

import corpus_pipeline
from seqloom.llm.common import stored
from seqloom.llm.decontaminate import IN_WORD
from seqloom.llm.toxicity import score_toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_what_a_plain_version_keeps(spark):
    from test_operators import Union, personal_base, plain_fingerprint

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    now = stored(stages["toxicity"](spark, docs, SMALL))
    scored = score_toxicity(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert ids(now) == ids(scored.where("score < 0.7")) and now.columns == columns

    before, now = now, stored(stages["near_duplicates"](spark, now, SMALL))
    prints = {r.doc_id: plain_fingerprint(r.text) for r in before.collect()}
    union, order = Union(prints), sorted(prints)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                union.join(a, b)
    assert ids(now) == sorted({union.find(i) for i in order})

    before, now = now, stored(stages["decontamination"](spark, now, SMALL))
    letters = bytes(b for b in range(256) if IN_WORD[b])
    words = lambda text: re.findall(rb"[" + re.escape(letters) + rb"]+", (text or "").encode().lower())
    windows = {}
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(r.text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(size, set()).add(tuple(w[i : i + size]))
    clean = []
    for r in before.collect():
        w, hit = words(r.text), set()
        for size, known in windows.items():
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in known:
                    hit.update(range(i, i + size))
        if not hit or 20 * len(hit) < len(w):
            clean.append(r.doc_id)
    assert ids(now) == sorted(clean) and len(clean) < before.count()

    before, now = now, stored(stages["personal_data"](spark, now, SMALL))
    after = {r.doc_id: r for r in now.collect()}
    assert ids(now) == ids(before)
    for r in before.collect():
        if personal_base(r.text):
            assert not [s for s in personal_base(after[r.doc_id].text)]
            assert after[r.doc_id].n_chars == len(after[r.doc_id].text)
        else:
            assert after[r.doc_id] == r

    mixed = stages["source_mix"](spark, now, SMALL).toPandas()
    assert (mixed.taken > 0).all() and (mixed.taken <= 3 * mixed["size"]).all()
    sources = mixed.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(sources.taken - sources.target) < 1).all()


def test_run_returns_the_mix(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "text", "taken"} <= set(out.columns) and out.count() > 0
