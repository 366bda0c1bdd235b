"""Ranked lexical search against brute force, its shards and blocks, and odd rows."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seqloom.llm import lexical as lx
from seqloom.llm.common import batches_of, shared_folder


def brute(docs, items, k):
    tokens = lambda t: re.findall(lx.TERM, t.translate(str.maketrans(lx.UPPER, lx.LOWER)) if t else "")
    tf = [(i, Counter(tokens(t))) for i, t in docs]
    sizes = [c.total() for _, c in tf]
    count, length = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(w for _, c in tf for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(tokens(t))
    out = []
    for i, words in asked.items():
        scored = []
        for (d, c), n in zip(tf, sizes):
            m = 50 + 50 * n * count // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if s > 0:
                scored.append((-s, math.inf if d is None else d))
        out += [(i, r + 1, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    words = ["Über", "naïve", "a", "B2", "z" * 300, "日本", "x_y", "don't", "the"] + [f"w{i}" for i in range(40)]
    text = lambda n: rng.choice((" ", ", ", "\n", "\u0000")).join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(300)] + [(301, None), (None, "w1 w2 the"), (302, ""), (303, "--- !"), (5, "w1 w1"), (5, "w1 w1"), (304, "the " * 20000)]
    items = [(i, text(rng.randint(1, 12))) for i in range(9)] + [(20, None), (21, ""), (None, "w3 W4"), (2, "b2 über"), (22, "unseen"), (23, "the the THE")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_equal_to_brute_force(tables):
    docs, items, d, q = tables
    assert rows(lx.search(lx.build_index(d, shard_bytes=700), q, k=7)) == brute(docs, items, 7)


def test_blocks_of_items(tables):
    docs, items, d, q = tables
    assert rows(lx.search(lx.build_index(d), q, k=50, block_terms=20)) == brute(docs, items, 50)


def test_ties_go_to_smaller_ids(spark):
    d = spark.createDataFrame([(i, "same words here") for i in (9, 3, 7, 1, 5)] + [(i, "other") for i in range(10, 30)], "doc_id int, text string").repartition(4)
    q = spark.createDataFrame([("q", "same")], "item_id string, text string")
    got = lx.search(lx.build_index(d, shard_bytes=1), q, k=3).orderBy("rank").collect()
    assert [(r.item_id, r.doc_id) for r in got] == [("q", 1), ("q", 3), ("q", 5)] and len({r.score for r in got}) == 1


def test_nothing_to_search(spark, tables):
    _, _, d, q = tables
    assert lx.search(lx.build_index(d.limit(0)), q).count() == 0
    assert lx.search(lx.build_index(d), q.limit(0)).count() == 0
    assert lx.search(lx.build_index(d.selectExpr("doc_id", "'--' as text")), q).count() == 0


def test_extra_columns(spark):
    d = spark.createDataFrame([(1, "a b", "x", 2.0)], "doc_id long, text string, terms string, Score double")
    q = spark.createDataFrame([(1, "a", 1)], "item_id long, text string, rank int")
    assert [(r.item_id, r.rank, r.doc_id) for r in lx.search(lx.build_index(d), q).collect()] == [(1, 1, 1)]


def test_postings_are_sorted_rows():
    texts = ["b a b", "", "A c"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    terms, at, docs, tf, sizes = lx.postings(data, offsets)
    held = {t.as_py(): [(int(docs[j]), int(tf[j])) for j in range(at[i], at[i + 1])] for i, t in enumerate(terms)}
    assert held == {b"b": [(0, 2)], b"a": [(0, 1), (2, 1)], b"c": [(2, 1)]} and sizes.tolist() == [3, 0, 2]


def test_query(spark, same_rows):
    same_rows(lx.query, lx.SQL)


def groups(folder, before):
    """Rows in each row group of the tables written since, by table."""
    files = [p for p in Path(folder).glob("table-*/part-*.parquet") if p.parent.name not in before]
    out = {}
    for p in files:
        m = pq.ParquetFile(p).metadata
        out.setdefault(p.parent.name, []).extend(m.row_group(g).num_rows for g in range(m.num_row_groups))
    return out


def test_a_task_holds_one_shard_at_a_time(spark, tables):
    docs, items, d, q = tables
    folder = shared_folder(spark).removeprefix("file:")
    before = {p.name for p in Path(folder).glob("table-*")}
    index = lx.build_index(d, shard_bytes=700)
    for block_terms in (1 << 20, 20):
        assert rows(lx.search(index, q, k=7, block_terms=block_terms)) == brute(docs, items, 7)
    assert not groups(folder, before)  # no shard is written
    assert rows(lx.search(index.kept(), q, k=7, block_terms=20)) == brute(docs, items, 7)
    (kept,) = groups(folder, before).values()
    assert len(kept) > 20 and set(kept) == {1}


def test_batches_are_small(spark):
    d = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("t"))

    def largest(batches):
        yield pa.RecordBatch.from_pydict({"n": [max(b.nbytes for b in batches)]})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), batches_of(spark, 20_000):
        assert d.mapInArrow(largest, "n long").first()[0] < 25_000
        1 / 0
    assert spark.conf.get(name) == usual and d.mapInArrow(largest, "n long").first()[0] > 1_000_000
