"""Models against plain versions in dictionaries, and inputs beyond the sizes that a batch, a clause or a packed key holds."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import anchors, common, decontaminate, induced, langid, pii, repeats, secrets, suffix_tree, toxicity

# language identification


def symbols_of(text):
    out = []
    for c in text:
        out.append(ord(c.lower()[0]) & 4095 if c.isalpha() else 32)
    return out


class PlainKneserNey:
    """Interpolated Kneser-Ney of one language, order 4, over folded characters."""

    def __init__(self, texts):
        top = Counter()
        for t in texts:
            s = [32] * 3 + symbols_of(t)
            top.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
        self.counts = {4: top}
        for k in (3, 2, 1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])

    def probability(self, gram):
        p = 1 / 4096
        for k in range(1, 5):
            g, counts = gram[4 - k :], self.counts[k]
            ones, twos = (sum(n == m for n in counts.values()) for m in (1, 2))
            discount = ones / (ones + 2 * twos) if ones else 0.5
            after = {h: n for h, n in counts.items() if h[:-1] == g[:-1]}
            if not after:
                continue
            total = sum(after.values())
            p = max(counts[g] - discount, 0) / total + discount * len(after) / total * p
        return p

    def entropy(self, text):
        s = [32] * 3 + symbols_of(text)
        return -sum(math.log(self.probability(tuple(s[i : i + 4]))) for i in range(len(text))) / max(1, len(text))


def test_language_models_equal_plain_ones():
    texts = {"a": ["The cat, the hat.", "a MAT and a cat"], "b": ["der Hut und die Katze", "Öl und übel; 12 Häuser"]}
    counts = {}
    for lang, own in texts.items():
        data, offsets = common.utf8(pa.array(own))
        keys, _, _ = langid.grams(data, offsets)
        counts[lang] = langid.counted(keys >> np.uint64(langid.DOC_BITS))
    model = langid.Model.fit(counts)
    asked = ["the cat", "die Katze", "ÜBER", "x", "12 34", "", "日本 cat"]
    cost, letters = model.entropy(pa.array(asked))
    for j, lang in enumerate(model.langs):
        plain = PlainKneserNey(texts[lang])
        assert cost[:, j] == pytest.approx([plain.entropy(t) for t in asked])
    assert letters.tolist() == [sum(c.isalpha() for c in t) for t in asked]


def test_more_texts_in_a_batch_than_a_key_can_number():
    data, offsets = common.utf8(pa.array(["the cat and the hat"] * 3))
    keys, _, _ = langid.grams(data, offsets)
    other, _, _ = langid.grams(*common.utf8(pa.array(["der Hut und die Katze"])))
    model = langid.Model.fit({"a": langid.counted(keys >> np.uint64(16)), "b": langid.counted(other >> np.uint64(16))})
    cost, _ = model.entropy(pa.array(["the cat"] * (1 << 16) + ["die Katze"] * 10))
    assert np.ptp(cost[: 1 << 16], axis=0).max() == 0 and np.ptp(cost[1 << 16 :], axis=0).max() == 0
    assert cost[0].argmin() == 0 and cost[-1].argmin() == 1


def test_strata_by_a_join(spark):
    rows = spark.createDataFrame([(i, "a" if i < 3000 else "b") for i in range(3050)] + [(i, None) for i in range(9000, 9010)], "id long, lang string")
    got = Counter(r.lang for r in common.sampled(rows, F.col("id"), F.col("lang"), 300).collect())
    assert 200 < got["a"] < 400 and got["b"] == 50 and got[None] == 10


# toxicity


def plain_clause(grammar, words):
    """Each matched word by what stands before it and in its clause, without states."""
    total, kinds = 0.0, [grammar.classes.get(w, "") for w in words]
    aimed = "target" in kinds
    for i, (word, kind) in enumerate(zip(words, kinds)):
        insult = grammar.weight(word) if not kind else 0.0
        if kind != "threat" and not insult:
            continue
        # a negation holds for the two words that follow it and is no match itself
        negated = "negation" in kinds[max(0, i - 2) : i]
        reported = "report" in kinds[:i]
        event = 8 * aimed + 4 * (kind == "threat") + 2 * negated + reported
        total += grammar.arcs[event] * (insult or 1.0)
    return total


def test_composed_automaton_equals_plain_rules():
    rng = random.Random(4)
    arcs = np.array([rng.random() for _ in range(toxicity.EVENTS)])
    grammar = toxicity.Grammar({"idiot": 2.0, "achlich*": 1.0}, arcs)
    bag = ["you", "idiot", "not", "said", "kill", "table", "achlichkeit", "never", "murder", "x"]
    for _ in range(3000):
        words = rng.choices(bag, k=rng.randint(0, 9))
        assert grammar.clause(words) == pytest.approx(plain_clause(grammar, words)), words


def test_clauses_of_any_length_are_whole():
    grammar = toxicity.Grammar({"idiot": 2.0})
    machine = grammar.automaton()
    for gap in (1, 1500, 40_000):
        for text in ("you " + "word " * gap + "idiot", "idiot " + "word " * gap + "you"):
            (found,) = grammar.clauses(text + ". idiot is here"[:0], machine)
            assert found == {8: 2.0}
    text = "a b. " + "idiot word " * 500 + "you! fine, said " + "word " * 3000 + "idiot; no. "
    got = list(grammar.clauses(text, machine))
    assert got == [{8: 1000.0}, {1: 2.0}]


def test_arcs_are_learned_from_labels():
    rng = np.random.default_rng(1)
    sums = rng.poisson(0.4, (3000, toxicity.EVENTS)).astype(float)
    true = toxicity.first_arcs().copy()
    true[2] = 3.0  # negated insults, say, count full and more in these labels
    y = (rng.random(3000) < 1 / (1 + np.exp(-(np.log1p(sums) @ true - 4)))).astype(float)
    got = toxicity.learned_arcs(sums, y, toxicity.first_arcs())
    assert got[2] > 1.5 and abs(got - true).mean() < abs(toxicity.first_arcs() - true).mean() + 0.3


# benchmark and repeats


def test_spans_go_for_all_blocks_of_the_benchmark(spark):
    docs = spark.createDataFrame([(1, "Keep A b C d, and E f g h! end"), (2, None), (3, "a b c d"), (4, "é e f g h é")], "doc_id int, text string")
    bench = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(["a b c d", "e f g h", "q r s", "t u v"])], "item_id string, text string")
    for block in (1, 1 << 20):
        got = {r.doc_id: r.clean_text for r in decontaminate.decontaminate(docs, bench, width=4, block_bytes=block, cleaned=True).collect()}
        assert got == {1: "Keep , and ! end", 2: None, 3: "", 4: "é  é"}


def test_anchors_of_texts_longer_than_places(spark):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 9000).astype(np.uint8)
    offsets = np.array([0, 0, 5000, 9000])
    whole, cut = (anchors.owned(data, offsets, 400, 128, place_bits=b) for b in (28, 10))
    rows = lambda x: sorted(zip(*(x[k].tolist() for k in ("doc", "first", "last"))))
    covered = lambda x: Counter((d, w) for d, a, b in rows(x) for w in range(a, b + 1))
    assert covered(whole) == covered(cut) and set(covered(cut).values()) == {1}


def test_substring_ranks_of_long_runs():
    s = np.array([3] * 5000 + [2, 3] + [3] * 4999 + [2, 1, 3] * 40 + [0])
    want = sorted(range(len(s)), key=lambda i: s[i : i + 5200].tolist() + [len(s) - i])
    assert induced.suffix_array(s).tolist() == want


def test_hot_keys_are_spread(spark):
    left = spark.createDataFrame([(i, 1 if i < 500 else i % 7) for i in range(1000)], "i int, k int").repartition(5)
    right = spark.createDataFrame([(k, f"v{k}") for k in range(6)], "k int, v string")
    hot = spark.createDataFrame([(1,), (99,)], "k int")
    for how in ("inner", "left"):
        got = sorted((r.i, r.k, r.v) for r in common.spread_join(left, right, ["k"], hot, how).collect() if r.v)
        assert got == sorted((r.i, r.k, f"v{r.k}") for r in left.collect() if r.k < 6)


def test_hot_passages_and_copies(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, copy = text(450), text(700)
    texts = [text(60) + passage + text(60) for _ in range(1100)] + [copy] * 1100 + [text(500) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    for r in repeats.remove_repeats(df, keep=["doc_id"]).collect():
        t, gone = texts[r.doc_id], set()
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone.update(range(i, i + 400))
        assert r.n_removed == len(gone)


# personal data


def test_added_spans_are_personal_data(spark):
    rng = random.Random(11)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = []
    for i in range(240):
        made.append((f"mail me: {name()} [at] {name()} [dot] com today", "email_like"))
        made.append((f"call ({rng.randint(200, 999)}) {number(3)}-{number(4)} now", "phone_like"))
        made.append((f"version 1.{rng.randint(300, 900)}.{rng.randint(300, 900)}.7 is out", None))
        made.append((f"order {'9' * 3}{number(12)}3 was sent", None))
        made.append((f"write to {name()}@{name()}.com or +1 (555) 010-{number(4)}, from {rng.randint(1, 255)}.{rng.randint(0, 255)}.1.9", ""))
        made.append((f"the {name()} of {name()} +{number(2)} {name()}", None))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id int, text string")
    got = {r.doc_id: [x.split(":")[0] for x in r.spans.split(",") if "_like" in x] for r in pii.find_personal_data(df, keep=["doc_id"]).collect()}
    for kind in ("email_like", "phone_like"):
        planted = [i for i, (_, k) in enumerate(made) if k == kind]
        assert sum(got[i] == [kind] for i in planted) >= 0.9 * len(planted)
    assert not any(got[i] for i, (_, k) in enumerate(made) if k is None)


def planted(spark, forms, seed):
    """Documents of which each has one of ``forms`` (kind, maker), put between two words: rows, and (kind, start, end) by id."""
    rng = random.Random(seed)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rows, places = [], {}
    for i, text in enumerate(texts):
        kind, make = forms[i % len(forms)]
        words = text.split(" ")
        at = rng.randint(0, len(words))
        lead, new = "".join(w + " " for w in words[:at]), make(rng)
        rows.append((i, lead + new + " " + " ".join(words[at:])))
        places[i] = kind, len(lead), len(lead) + len(new)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), places


def quality(found, places, added):
    """Recall of what was planted as an added kind, and precision of the added spans."""
    spans = [(i, k, int(a), int(b)) for i, listed in found.items() for k, a, b in (x.split(":") for x in listed.split(",") if x) if k in added]
    right = {i for i, k, a, b in spans if k == places[i][0] and a < places[i][2] and b > places[i][1]}
    wanted = [i for i, p in places.items() if p[0] in added]
    return len(right) / len(wanted), sum(i in right for i, *_ in spans) / max(1, len(spans))


def test_quality_of_added_personal_data(spark):
    digits = lambda r, n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda r: "".join(r.choice("abcdefghijklm") for _ in range(6))
    forms = [
        ("email_like", lambda r: f"mail {name(r)} [at] {name(r)} [dot] {r.choice(('com', 'org', 'de'))}"),
        ("phone_like", lambda r: f"{r.choice(('call ', '', 'tel. '))}{r.randint(201, 989)}-{digits(r, 3)}-{digits(r, 4)}"),
        (None, lambda r: f"version 1.{r.randint(300, 900)}.{r.randint(300, 900)}.7"),
        (None, lambda r: f"order {digits(r, 16)}"),
        (None, lambda r: f"invoice {digits(r, 3)}-{digits(r, 2)}-{digits(r, 6)}"),
        (None, lambda r: f"{name(r)}@{name(r)}.com, +1 (555) 010-{digits(r, 4)}, {r.randint(1, 255)}.{r.randint(0, 255)}.1.9, 4111 1111 1111 1111"),
        (None, lambda r: "nothing"),
    ]
    df, places = planted(spark, forms, 5)
    found = {r.doc_id: r.spans for r in pii.find_personal_data(df, keep=["doc_id"]).collect()}
    recall, precision = quality(found, places, pii.ADDED)
    assert recall > 0.9 and precision > 0.9


def test_quality_of_random_strings(spark):
    """Keys of three alphabets among words, identifiers and addresses."""
    key = lambda symbols, *sizes: lambda r: "".join(r.choice(symbols) for _ in range(r.choice(sizes)))
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = lambda r: r.choice("reading station thing content others measure garden window".split())
    forms = [
        ("random", key(upper + lower + digits, 16, 20, 24, 32, 40)),
        ("random", key(upper + "234567", 16, 20, 24, 32, 40)),
        ("random", key("0123456789abcdef", 16, 18, 20, 22)),
        (None, lambda r: "_".join(word(r) for _ in range(4))),
        (None, lambda r: f"https://{word(r)}.example.com/{word(r)}/{r.randint(1, 9999)}.html"),
        (None, lambda r: "get" + "".join(word(r).capitalize() for _ in range(3)) + str(r.randint(1, 99))),
    ]
    df, places = planted(spark, forms, 6)
    found = {r.doc_id: r.spans for r in secrets.find_secrets(df, keep=["doc_id"]).collect()}
    recall, precision = quality(found, places, ["random"])
    assert recall > 0.9 and precision > 0.95


def test_secret_scan_makes_one_text_at_a_time_a_string(spark, capsys):
    """A pandas scan held all texts of a batch as strings, which made a worker's memory follow the size of texts."""
    from pyspark.util import PythonEvalType

    texts = [None, "", "naïve token = 'abcdef0123' " * 3, "é" * 50 + " AKIA" + "Z" * 16]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.find_secrets(df, keep=["doc_id"], train_rows=4)
    found.explain()
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_UDF}\n" in capsys.readouterr().out
    rows = {r.doc_id: r for r in found.collect()}
    for i, text in enumerate(texts):
        want = secrets.base_spans(text or "")
        assert [(s.start, s.end, s.kind) for s in rows[i].found if s.kind != "random"] == want
        assert (rows[i].n_assign, rows[i].n_access) == (sum(s[2] == "assign" for s in want), sum(s[2] == "access" for s in want))


@pytest.mark.parametrize("most", [7, 1 << 22])
def test_words_and_joints_of_parts(most):
    """Numbered words and joints are those of whole texts, whatever the parts; all kinds of white space, no words, other letters."""
    texts = ["Ab ab\tAB  x\x0b", None, "", "  ", "ÉTÉ été 日本 a b \x1cq", "one", "a\nlonger text of\r\nseveral words, a LONGER text" * 2]
    got: dict[int, tuple[list, list]] = {i: ([], []) for i in range(len(texts))}
    for part in suffix_tree.parts(pa.array(["left out", *texts], pa.string())[1:], True, most):
        for t, w, j in zip(part.text.tolist(), part.word.tolist(), part.joint.tolist()):
            got[part.low + t][0].append(part.words[w])
            got[part.low + t][1].append(part.joints[j])
    for i, text in enumerate(texts):
        words = [*(text or "").encode().lower().split(), b""]
        assert got[i] == (words, suffix_tree.joints(words, b""))


def test_unigrams_need_no_tree(spark, monkeypatch):
    """The baseline alone counts words; its figures are those beside the tree."""
    df = spark.createDataFrame([(i, " ".join(f"w{j % (i + 2)}" for j in range(i))) for i in range(12)] + [(99, None)], "doc_id long, text string")
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score"]
    for head in (2, 1 << 18):
        want = suffix_tree.score_texts(df, F.col("doc_id") < 6, keep=["doc_id"], head_words=head).select(*names).collect()
        with monkeypatch.context() as m:
            m.setattr(suffix_tree, "gained", None)
            got = suffix_tree.score_texts(df, F.col("doc_id") < 6, keep=["doc_id"], head_words=head, tree=False).select(*names).collect()
        assert len(got) == 13
        for a, b in zip(sorted(got), sorted(want)):
            assert a[:4] == b[:4] and a.base_score == pytest.approx(b.base_score)


def test_joints_by_number():
    """A joint's number is spelled as the joint: short and long ends, zero bytes, other letters, a text's start and end."""
    words = [b"", b"a", b"ab", b"abc", b"xabcd", b"\x00", b"\x00\x00", b"a\x00\x00\x00", "日本".encode(), b"\xff\xff\xff"]
    tails, heads = suffix_tree.ends_of(pa.array(["left out", *words], pa.binary())[1:])
    pairs = [(i, j) for i in range(len(words)) for j in range(len(words))]
    numbers = np.array([tails[i] << suffix_tree.END_BITS | heads[j] for i, j in pairs])
    want = [suffix_tree.joints([words[j]], words[i])[0] for i, j in pairs]
    assert suffix_tree.spelled(numbers).to_pylist() == want
    assert suffix_tree.spelled(numbers, b"j").to_pylist() == [b"j" + w for w in want]
    assert suffix_tree.numbers_of(pa.array(want, pa.binary())).tolist() == numbers.tolist()
    assert suffix_tree.spelled(numbers[:0]).to_pylist() == [] == suffix_tree.numbers_of(pa.array([], pa.binary())).tolist()


@pytest.mark.parametrize("head", [2, 1 << 18])
def test_units_reach_the_driver_as_columns(spark, monkeypatch, head):
    """The words and joints that go to every task are columns, no objects of the driver's Python."""
    sent = []
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(0)), "toPandas", lambda self: pytest.fail("rows become objects of the driver"))
        m.setattr(type(spark.sparkContext), "broadcast", lambda self, value, f=spark.sparkContext.broadcast: sent.append(value) or f(value))
        df = spark.createDataFrame([(i, f"a b{i} c{i % 3}") for i in range(9)], "doc_id long, text string")
        assert all(r.score < 0 for r in suffix_tree.score_texts(df, head_words=head).collect())
    for units, *figures in sent[-1]:
        assert isinstance(units, pa.Array) and all(isinstance(x, np.ndarray) for x in figures)
