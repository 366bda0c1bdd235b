"""The ten operators against SQL, brute force, or held-out accuracy, on the smallest tables."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import common, decontaminate, induced, langid, mixing, pii, queries, repeats, secrets, simhash, suffix_tree, topk, toxicity

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs(spark, sf=SMALL):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.SQL[name])


def test_all_operators_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES if n.startswith("op")] == [f"op{i}" for i in range(1, 14)]


# 1


def test_mix_spends_the_budget_and_repeats(spark):
    rows = [(i, "w " * (1 + i % 7), s) for i, s in enumerate(["a"] * 400 + ["b"] * 5 + [None] * 60)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    by = got.groupby(got.source.fillna("none")).agg(taken=("taken", "sum"), target=("target", "first"), source_size=("source_size", "first"))
    assert (abs(by.taken - by.target) < 1).all() and (by.target <= 3 * by.source_size).all()
    assert by.target.sum() == pytest.approx(got["size"].sum())


# 2


def secret_base(text):
    found = []
    for kind, pattern, test in (
        (0, re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[1]) >= 6),
        (1, re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (2, re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text or "") if test(m)]
    names = ("assign", "access", "hex")
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(found)), [sum(k == j for _, k, _ in found) for j in range(3)]


def test_secret_rules(spark):
    made = [None, "", "tokKen=abcdefgh", "API_KEY: 'abcdef'", "passwd=abc", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "x" * 50 + "f" * 24 + "g", "é😀 secret = \"s3cr3t-value\" é", "token=secret=abcdef"]
    df = docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(made)], "doc_id long, text string"))
    text = {r.doc_id: r.text for r in df.collect()}
    for r in secrets.find_secrets(df, keep=["doc_id"]).collect():
        listed, counts = secret_base(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == counts


def test_random_strings_are_told_from_identifiers(spark):
    rng = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    key = lambda symbols, n: "".join(rng.choice(symbols) for _ in range(n))
    keys = [key(letters + "0123456789", 32) for _ in range(40)] + [key(letters + "0123456789", 18) for _ in range(40)] + [key(letters, 20) for _ in range(40)]
    plain = [f"the_{a}_of_{b}_in_version_{i}" for i, (a, b) in enumerate(zip(["reading", "station", "thing"] * 14, ["content", "others", "measure"] * 14))]
    df = docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, f"is {k} here") for i, k in enumerate(keys + plain)], "doc_id long, text string"))
    got = {r.doc_id - 10**6: r.n_random for r in secrets.find_secrets(df, keep=["doc_id"]).where("doc_id >= 1000000").collect()}
    assert sum(got[i] for i in range(len(keys))) >= 0.9 * len(keys)
    assert sum(got[i] for i in range(len(keys), len(got))) <= 0.05 * len(plain)


def test_parts_beside_rule_spans_are_judged():
    text = "token=abcdef/" + "0" * 30 + " " + "x" * 20 + "f" * 24 + "y" * 15
    base = secrets.base_spans(text)
    parts = [text[a:b] for a, b in secrets.left_over(text, base)]
    assert parts == ["x" * 20] and [k for *_, k in base] == ["assign", "hex", "hex"]


# 3


def test_languages_of_held_out_texts(spark):
    got = langid.query(spark, MEDIUM).join(docs(spark, MEDIUM).select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    counts = {}
    for lang in ("a", "b"):
        found, n = np.unique(sum(rng.integers(97, 101, 400).astype(np.uint64) << np.uint64(12 * k) for k in range(4)), return_counts=True)
        counts[lang] = (found, n)
    model = langid.Model.fit(counts)
    context = np.uint64(0x061062063000)
    every = np.array([context | np.uint64(b) for b in range(1 << 12)], np.uint64)
    assert model.probability(every).sum(axis=0) == pytest.approx([1, 1])


# 4


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(1)
    for _ in range(20):
        text = np.append(rng.integers(1, 6, int(rng.integers(2, 60))), 0)  # 5 stands for separators
        windows = np.zeros((12, 5), np.int64)
        for i in range(12):
            windows[i, 5 - (1 + i % 4) :] = rng.integers(1, 5, 1 + i % 4)
        row, at = decontaminate.Index(text, every=3).search(windows)
        want = []
        for i, w in enumerate(windows):
            w = w[w > 0]
            want += [(i, a) for a in range(len(text) - len(w) + 1) if (text[a : a + len(w)] == w).all()]
        assert sorted(zip(row.tolist(), at.tolist())) == sorted(want)


def test_blocks_of_the_benchmark_agree_and_spans_go(spark):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    one = decontaminate.decontaminate(docs(spark), bench, keep=["doc_id"]).orderBy("doc_id").collect()
    many = decontaminate.decontaminate(docs(spark), bench, keep=["doc_id"], block_bytes=2000).orderBy("doc_id").collect()
    assert one == many and any(r.contaminated for r in one)
    words = [f"w{i}" for i in range(13)]
    d = spark.createDataFrame([(1, "Start, " + " ".join(words).upper() + "! And the end."), (2, "clean text")], "doc_id int, text string")
    b = spark.createDataFrame([("x", " ".join(words)), ("y", "!!!"), (None, None)], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(d, b, cleaned=True).collect()}
    assert got[1].n_hit == 13 and got[1].clean_text == "Start, ! And the end." and got[2].clean_text == "clean text"


# 5


def personal_base(text):
    text, found = text or "", []
    found += [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_personal_data_rules(spark):
    rng = random.Random(3)
    bits = ["@a.b-", "0123456789", "+ 1().-", "é😀 x", "..", "4539 1488 0343 6467 ", "4 5-3 9 1-4-8 8 0 3-4 3 6 4-6 7", "a@b.c", "255.1.2.3", "+1 (555) 010-9999", "0 0", "[at]"]
    made = ["".join(rng.choice(rng.choice(bits)) if rng.random() < 0.8 else rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    made += [None, "", "1 " * 30000, "a@b" + ".c" * 30000, "a" * 100000, "+1" + " " * 50000 + "5", "a@b.cc..dd@e.ff", "a@b.c_x@e.f", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "x 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1.", "4 11-1111111 1-1 1 1 1-1 8", "4539-1488-0343-6467  4539 1488 0343 6467"]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for r in pii.find_personal_data(df, keep=["doc_id"]).collect():
        want = personal_base(made[r.doc_id])
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), made[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in want) for j in range(4)]


def test_redaction_and_native_plan(spark, capsys):
    df = spark.createDataFrame([(1, "mail a@b.com or +1 (555) 010-9999, é"), (2, "none"), (3, None)], "doc_id int, text string")
    out = pii.find_personal_data(df, redacted=True)
    assert {r.doc_id: r.redacted_text for r in out.collect()} == {1: "mail [EMAIL] or [PHONE], é", 2: "none", 3: None}
    out.explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


# 6


def test_toxic_texts_of_the_held_out_fold(spark):
    got = toxicity.query(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").where("held_out").toPandas()
    flagged = got[got.predicted == 1]
    assert len(flagged) and flagged.toxic.mean() > 0.9 and got[got.toxic == 1].predicted.mean() > 0.75


def test_clauses_are_scored_not_words():
    g = toxicity.Grammar({"idiot": 2.0, "achlich*": 1.0})
    score = lambda text: g.clause(toxicity.WORD.findall(text))
    assert score("you idiot") > score("an idiot") > score("not an idiot") > 0
    assert score("they said he is an idiot") < score("he is an idiot")
    assert score("kill time") == 0 < score("i will kill you")
    assert score("achlichkeit") == 1.0 and score("ach lich") == 0


# 7


def test_unigram_baseline_is_exact(spark):
    d = docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \t\n"), (10**6 + 3, "\x1f é É A")], "doc_id long, text string"))
    held = d.withColumn("held_out", suffix_tree.in_fold(F.col("doc_id"), 10, 0))
    for head in (1 << 16, 300):
        got = {r.doc_id: r for r in suffix_tree.score_texts(held, ~F.col("held_out"), keep=["doc_id"], head_words=head).collect()}
        tokens = {r.doc_id: [*WORD.findall(lowered(r.text)), None] for r in d.collect()}
        c = Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 10 for t in ts)
        n, v = sum(c.values()), len(c)
        for i, ts in tokens.items():
            want = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
            assert got[i].base_score == pytest.approx(want)
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ts), sum(c[t] > 0 for t in ts), n)
            assert got[i].score < 0


class PlainTree:
    """A suffix tree over the bytes of texts in dictionaries."""

    def __init__(self, texts, nats):
        self.counts, self.nats = {}, nats
        for words in texts:
            for context, symbol in self.steps(words):
                for d in range(len(context) + 1):
                    self.counts.setdefault(context[:d], Counter())[symbol] += 1

    @staticmethod
    def steps(words):
        before = b""
        for word in words:
            for i, symbol in enumerate(word + b" " if word else b"\n"):
                own = word[:i][::-1]
                if i < suffix_tree.HEAD:
                    own += b" " + before[-suffix_tree.TAIL :][::-1]
                yield (own + b"\x09")[: suffix_tree.DEPTH], symbol
            before = word

    @functools.cache
    def is_state(self, context):
        own, above = self.counts.get(context, Counter()), self.counts.get(context[:-1], Counter())
        c, up = own.total(), above.total()
        return c > 1 and sum(n * math.log(n / c / (above[s] / up)) for s, n in own.items()) >= self.nats

    @functools.cache
    def probability(self, context, symbol):
        root = self.counts.get(b"", Counter())
        p = (root[symbol] + 0.5) / (root.total() + 128)
        for d in range(1, len(context) + 1):
            if self.is_state(context[:d]):
                own = self.counts[context[:d]]
                p = (own[symbol] + len(own) * p) / (own.total() + len(own))
        return p

    def score(self, words):
        return sum(math.log10(self.probability(*step)) for step in self.steps(words))


def words_of(text):
    return [*(text or "").encode().lower().split(), b""]


@pytest.mark.parametrize("head", [0, 300, 1 << 18])
def test_tree_equals_a_plain_one(spark, head):
    rows = [(r.doc_id, r.text) for r in docs(spark).select("doc_id", "text").limit(60).collect()]
    rows += [(10**6, None), (10**6 + 1, "a" * 40 + " " + "a" * 39 + "b" + " qabcdefghijklr xabcdefghijklz" * 9), (10**6 + 2, "\x00 \x00\x00 \x01a"), (10**6 + 3, "")] * 3
    learns = [i % 3 > 0 for i in range(len(rows))]
    df = spark.createDataFrame([(*r, x) for r, x in zip(rows, learns)], "doc_id long, text string, own boolean")
    tree = PlainTree([words_of(r[1]) for r, x in zip(rows, learns) if x], 8.0)
    assert any(len(c) == d and tree.is_state(c) for c in tree.counts for d in (5, 12))
    want = {r: tree.score(words_of(r[1])) for r in rows}
    got = suffix_tree.score_texts(df, F.col("own"), head_words=head).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id, r.text])


def test_tree_spares_memory(spark, monkeypatch):
    """Tasks are sent 4 MB at a time, and idle workers don't keep what they freed."""
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    usual = spark.conf.get(name)
    monkeypatch.setattr(suffix_tree, "stored", lambda df: seen.append(spark.conf.get(name)) or common.stored(df))
    df = spark.createDataFrame([(i, f"word{i} and word{i + 1}") for i in range(40)], "doc_id long, text string")
    assert suffix_tree.score_texts(df, head_words=2).count() == 40
    assert set(seen) == {f"{4 << 20}b"} and len(seen) == 3 and spark.conf.get(name) == usual

    def pools(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"pool": [pa.default_memory_pool().backend_name]})

    assert "system" in {r.pool for r in spark.range(64).repartition(8).mapInArrow(pools, "pool string").collect()}


def test_tree_is_a_distribution_and_prunes():
    texts = ["ab ab  cab abc", "", None, " hello world hello", "aa aa aa"] * 3
    units = Counter()
    for words in map(words_of, texts):
        units.update(b"w" + w for w in words)
        units.update(b"j" + j for j in suffix_tree.joints(words, b""))
    n = np.array(list(units.values()))
    of, _, high, low = suffix_tree.keys_of(list(units))
    assert n[of].sum() == sum(len(w) + 1 for t in texts for w in words_of(t))
    for nats in (0.0, 2.0, 1e9):
        tree = suffix_tree.Tree.grow(suffix_tree.short_keys(high, low), n[of], nats)
        assert sum(len(x[0]) for x in tree.levels) == 0 if nats > 2 else any(len(x[0]) for x in tree.levels)
        for context in {(int(a), int(b) >> 8) for a, b in zip(high, low)}:
            a = np.full(256, context[0], np.uint64)
            b = (np.full(256, context[1], np.uint64) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
            times = np.array([sum(int(k) for x, y, k in zip(high, low, n[of]) if x == a[0] and y == z) for z in b])
            assert suffix_tree.branch(tree, a, b, times, nats).sum() == pytest.approx(1)


def test_words_are_told_apart_by_their_letters(spark):
    line = "a"
    for _ in range(10):
        line += line.translate(str.maketrans("ab", "ba"))
    twin = line.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, line, True), (2, twin, False)], "doc_id int, text string, own boolean")
    for head in (0, 100):
        got = {r.doc_id: r for r in suffix_tree.score_texts(df, F.col("own"), keep=["doc_id"], head_words=head).collect()}
        assert (got[1].n_known, got[2].n_known) == (2, 1)
        assert got[2].base_score == pytest.approx(math.log10(0.1 / 2.3) + math.log10(1.1 / 2.3))


def test_rare_and_long_contexts_count_whatever_the_size_of_the_corpus(spark):
    learned = [*["ab " * 4_000_000], *["qxzjw"] * 5, *["amnopqrstuvx", "bmnopqrstuvy"] * 50]
    asked = ["qxzjw", "qxzjk", "amnopqrstuvx", "amnopqrstuvy"]
    df = spark.createDataFrame([(i, t, i < len(learned)) for i, t in enumerate(learned + asked)], "doc_id int, text string, own boolean")
    got = {r.doc_id - len(learned): r.score for r in suffix_tree.score_texts(df, F.col("own"), keep=["doc_id"], head_words=2).collect()}
    assert got[0] > got[1] + 2
    assert got[2] > got[3] + 1


def test_long_texts_are_taken_in_pieces():
    text = b"Ab c\x0bdef  gh\n" * 50 + b"x" * 40
    assert sum(suffix_tree.tokens(text, most=7), []) == [*text.lower().split(), b""]


# 8


def plain_fingerprint(text):
    words = WORD.findall(lowered(text))
    if not words:
        return 0
    each = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in each]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_components_of_documents(spark):
    d = docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a b"), (10**6 + 3, "A  B")], "doc_id long, text string"))
    print_of = {r.doc_id: plain_fingerprint(r.text) for r in d.collect()}
    union, ids = Union(print_of), sorted(print_of)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (print_of[a] ^ print_of[b]).bit_count() <= 3:
                union.join(a, b)
    for r in simhash.near_duplicates(d, keep=["doc_id"]).collect():
        assert r.fp == simhash.signed(print_of[r.doc_id]) and r.component_id == union.find(r.doc_id)
    kept = {r.doc_id for r in simhash.deduplicate(d).collect()}
    assert kept == {union.find(i) for i in ids}


def test_links_of_dense_groups(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(15):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(25):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)) if rng.random() < 0.6 else rng.sample(range(16), rng.randint(1, 5)):
                y ^= 1 << b
            prints.add(y)
            x = y if rng.random() < 0.3 else x
    nodes = sorted(map(simhash.signed, prints))
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want, got = Union(nodes), Union(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if far(a, b) <= 3:
                want.join(a, b)
    edges, roots = simhash.linked(spark.createDataFrame([(p,) for p in nodes], "fp long"))
    for u, v in edges.collect():
        assert far(u, v) <= 3
        got.join(u, v)
    assert all(want.find(n) == got.find(n) for n in nodes)
    roots = {r.node: r.root for r in roots.collect()}
    assert all(roots.get(n, n) == want.find(n) for n in nodes)


# 9


def plain_removal(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_planted_passages_go_if_they_have_400_bytes(spark):
    """Passages of over 50 words that two texts share: removed from 400 bytes on, whole; shorter ones and clean texts stay as they are."""
    word = lambda key, n: "".join(chr(97 + zlib.crc32(f"{key} {i}".encode()) % 26) for i in range(n))
    text = lambda key, n, size: " ".join(word(f"{key} {i}", size) for i in range(n))
    passages = {"long": text("p", 52, 8), "exact": text("q", 51, 6) + " " + "z" * 43, "short": text("r", 51, 6)}
    assert [len(passages[k]) for k in ("long", "exact", "short")] == [467, 400, 356]
    rows = [(f"{k} {i}", f"{text(f'{k}{i}', 90, 7)}{i}{p}{i}{text(f'{i}{k}', 90, 7)}") for k, p in passages.items() for i in range(2)]
    rows += [(f"clean {i}", text(f"clean {i}", 150, 7)) for i in range(4)]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for k, t in rows:
        kind = k.split()[0]
        gone = passages[kind] if kind in ("long", "exact") else ""
        assert (got[k].n_removed, got[k].n_spans, got[k].n_bytes) == (len(gone), int(gone != ""), len(t))
        assert got[k].kept_sha256 == hashlib.sha256(t.replace(gone, "").encode()).hexdigest()


@pytest.mark.parametrize("most", [1000, 2])
def test_repeats(spark, most):
    rng = random.Random(1)
    shared = ["".join(rng.choice("ab é") for _ in range(rng.randint(100, 900))) for _ in range(8)]
    texts = ["".join(rng.choice(shared) if rng.random() < 0.4 else "".join(rng.choice("ab é") for _ in range(rng.randint(1, 500))) for _ in range(rng.randint(0, 5))) for _ in range(80)]
    texts += [None, "", "a" * 3000, "a" * 399, "a" * 400, "ab" * 900, "xyz " * 300, *texts[:6]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in repeats.remove_repeats(df, keep=["doc_id"], shard_bytes=40000, most=most).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts, 400)


def test_induced_sorting_and_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(120):
        n, k = int(rng.integers(1, 80)), int(rng.integers(1, 4))
        s = np.append(rng.integers(1, k + 1, n), 0)
        if trial % 3 == 0:
            s[:-1] = np.tile(rng.integers(1, k + 1, max(1, n // 3)), 10)[:n]
        order, own = induced.suffix_array(s), s.tolist()
        want = sorted(range(len(s)), key=lambda i: own[i:])
        assert order.tolist() == want
        before, common = induced.permuted_prefixes(s.astype(np.uint16), order, 1)
        for a, b in zip(want, want[1:]):
            c = 0
            while b + c < len(s) and a + c < len(s) and own[a + c] == own[b + c] != 1:
                c += 1
            assert before[b] == a and common[b] == c


# 10


@pytest.mark.parametrize("shard_rows", [4096, 7])
def test_top_k_is_exact(spark, shard_rows):
    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, (150, 5)).astype(float)
    v[10] = v[20] = v[30]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, None]), (902, [float("nan")]), (None, [1.0]), (903, [float("inf")]), (904, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, shard_rows=shard_rows, block_rows=4).collect()}
    for q in range(0, 150, 10):
        best = sorted([(-float(v[q] @ v[i]), i) for i in range(150) if i != q] + [(0.0, 904)])[:5]
        assert [got[q, r] for r in range(1, 6)] == [(i, -s) for s, i in best]
