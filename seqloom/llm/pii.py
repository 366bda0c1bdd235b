"""Personal data by weak supervision, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, quoted, read

KINDS = ("email", "ip", "card", "phone")
ADDED = tuple(f"{k}_like" for k in KINDS)
LABELERS = ("rule", "gazetteer", "context", "shape", "check")
FEATURES = ("digits", "marked", "line_start", "long", "parted", "touching")
#: The rule misses at most one true span in ten on which it votes: who fails a check sum or a byte's range needs other evidence.
RULE_HITS = 0.9
#: Labelers that may abstain; a bit for each, after the votes, says that it voted.
ABSTAINING = ("rule", "gazetteer", "context")
BITS, VOTES = len(LABELERS) + len(ABSTAINING) + len(FEATURES), (1 << len(LABELERS) + len(ABSTAINING)) - 1

# The contract's patterns, in forms that neither try a run of letters or digits
# from each of its places nor recurse once for each repeated group.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.\.|\.?(?![A-Za-z0-9.-]))"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x20-]*?(?=[\x20-](?![0-9])|(?![0-9\x20-]))"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser candidates, none of which touches a match of the patterns above.
EMAIL_LIKE = r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}){1,4}"
PHONE_LIKE = r"(?<![0-9A-Za-z+().-])(?<!\+[0-9]{1,3}[\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z])"

# Gazetteers and context words (fixed values).
DOMAINS = r"(?i)(?:\.|[\])]\x20?)(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
FILES = r"(?i)\.(png|jpe?g|gif|svg|css|js|py|txt|html?)$"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6)"
CONTEXT = {
    "email": r"(?i)(mail|contact|write|kontakt|schreib|courriel|correo|contacto|adresse)",
    "ip": r"(?i)(ip|addr|host|server|client|serveur|servidor)",
    "card": r"(?i)(card|visa|credit|debit|karte|carte|tarjeta|pay)",
    "phone": r"(?i)(tel|phone|call|mobile|fax|anruf|ruf|appel|llam|m[oó]vil)",
}
# Words that name something else when they end just before a span (fixed values).
ELSE = r"(?i)(version|order|invoice|isbn|serial|sku|build|release|item|bestellung|rechnung|commande|facture|pedido|factura)[\x20:#.]*$"

FOUND = "array<struct<start:int,end:int,match:string,before:string>>"


def located(text: Column, pattern: str, needed: Column) -> Column:
    """Matches with offsets in code points and the 40 characters before each; looked for only where ``needed`` holds.

    What lies between the matches is split off, so a running sum of lengths
    gives the offsets.
    """
    gaps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    none = F.array().cast(FOUND)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        before = F.coalesce(F.substring(x["gap"], -40, 40), F.lit(""))
        one = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), before.alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.when(x["match"].isNull(), none).otherwise(F.array(one))).alias("found"))

    start = F.struct(F.lit(0).alias("at"), none.alias("found"))
    return F.when(needed, F.aggregate(gaps, start, step, lambda acc: acc["found"])).otherwise(none)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of up to 19 digits passes the check sum."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, n - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def byte_parts(match: Column) -> Column:
    part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.forall(F.split(match, r"\."), lambda x: (F.length(part(x)) <= 3) & (part(x).cast("int") <= 255))


def bits(tests: Iterable[Column]) -> Column:
    total = F.lit(0)
    for i, test in enumerate(tests):
        total = total + F.when(test, 1 << i).otherwise(0)
    return total.cast("int")


def evidence(kind: str, x: Column, rule: Column | None, known: Column, unknown: Column, shape: Column, check: Column) -> Column:
    """The labelers' votes, whether those that may abstain voted, then features of the span and of what stands before it.

    In the order of LABELERS, ABSTAINING and FEATURES. Null tests count as false.
    """
    match, before = x["match"], x["before"]
    named, other = before.rlike(CONTEXT[kind]), before.rlike(ELSE)
    return bits(
        (
            F.lit(False) if rule is None else rule,
            known,
            named & ~other,
            shape,
            check,
            F.lit(rule is not None),
            known | unknown,
            named | other,
            2 * F.length(digits(match)) > F.length(match),
            before.rlike(r"[:=<(\[\"']\x20?$"),
            (before == "") | before.rlike(r"\n\x20*$"),
            F.length(match) > 20,
            match.rlike(r"[\x20()\[\]-]"),
            before.rlike(r"[A-Za-z0-9_]$"),
        )
    )


def candidates(text: Column) -> Column:
    """All spans that the labelers look at: what the patterns find, whether or not it meets the contract (strict), and looser forms.

    No labeler repeats another: the rule is the contract's and abstains on
    looser forms; the gazetteer knows domains and file endings, networks,
    issuers and country codes, and abstains on what it doesn't list; the words
    before a span speak for its kind or for something else, or abstain; the
    shape is a usual length, and the check is of how the span is written.
    """

    def spans(kind: str, found: Column, rule, known, unknown, shape, check) -> Column:
        k = KINDS.index(kind)

        def span(x: Column) -> Column:
            m = x["match"]
            strict = None if rule is None else rule(m)
            votes = evidence(kind, x, strict, known(m), unknown(m), shape(m), check(m))
            return F.struct(F.lit(k).alias("kind"), (F.lit(False) if rule is None else strict).alias("strict"), x["start"].alias("start"), x["end"].alias("end"), votes.alias("bits"))

        return F.transform(found, span)

    like = lambda pattern: lambda m: m.rlike(pattern)
    number = lambda m: F.length(digits(m))
    short = lambda m: F.length(m) <= 80
    written = lambda m: m.rlike(r"^[A-Za-z][A-Za-z0-9._+-]*[A-Za-z0-9]\x20?[@\[(]") & ~m.contains("..")
    dialled = lambda m: number(m).between(10, 13)
    grouped = like(r"^\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{1,4}\)?(?:[\x20.-][0-9]{2,4}){1,5}$")
    at, many, plus = text.contains("@"), text.rlike("[0-9]"), text.contains("+")
    sixteen = text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")
    return F.concat(
        spans("email", located(text, EMAIL, at), lambda m: F.lit(True), like(DOMAINS), like(FILES), short, written),
        spans("email", located(text, EMAIL_LIKE, text.rlike(r"[\[(]at[\])]")), None, like(DOMAINS), like(FILES), short, written),
        spans(
            "ip",
            located(text, IP, many),
            byte_parts,
            like(r"^(10|127|172|192)\."),
            like(r"^(0+|22[4-9]|2[3-9][0-9]|[3-9][0-9]{2})\."),
            lambda m: F.length(m).between(7, 15),
            lambda m: ~m.rlike(r"(^|\.)0[0-9]|^0\."),
        ),
        spans(
            "card",
            F.filter(located(text, CARD, sixteen), lambda x: number(x["match"]).between(16, 19)),
            lambda m: luhn(digits(m)),
            like(ISSUERS),
            like(r"^[01789]"),
            lambda m: number(m) == 16,
            like(r"^(?:[0-9]{16,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}(?:[\x20-]?[0-9]{1,3})?)$"),
        ),
        spans("phone", located(text, PHONE, plus), lambda m: number(m).between(8, 15), like(r"^\+(1|33|34|44|49)\b"), like(r"^\+0"), dialled, grouped),
        spans("phone", located(text, PHONE_LIKE, many), None, like(r"^\(?[2-9]"), like(r"^\(?[01]"), dialled, grouped),
    )


def cast(votes: int, i: int) -> bool:
    """Whether labeler ``i`` voted."""
    name = LABELERS[i]
    return name not in ABSTAINING or bool(votes >> len(LABELERS) + ABSTAINING.index(name) & 1)


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 50) -> dict[tuple[int, int], float]:
    """Posterior of each (kind, votes) by expectation-maximisation over labelers' hit and false-alarm rates.

    Starts from the share of yes among the votes cast, each weighed by how much
    its labeler tells spans apart (the variance of its votes, 0.02 at least, so
    that where all agree they are believed). There is one rate of true spans for each kind and one pair of rates for each labeler and kind,
    over the spans on which it voted; who abstains says nothing. Priors keep
    rates off 0 and 1. A labeler is never worse than chance: where its hits
    would fall below its false alarms both are its common rate, so that no
    labeler can turn the two classes around; the rule's hits are RULE_HITS at
    least.
    """
    labelers = range(len(LABELERS))
    voters = {votes: [i for i in labelers if cast(votes, i)] for _, votes in counts}
    weight = {}
    for kind, i in ((kind, i) for kind in range(len(KINDS)) for i in labelers):
        voted = [(k, n) for k, n in counts.items() if k[0] == kind and i in voters[k[1]]]
        yes = sum(n for k, n in voted if k[1] >> i & 1) / (sum(n for _, n in voted) or 1)
        weight[kind, i] = max(0.02, yes * (1 - yes))
    post = {}
    for kind, votes in counts:
        own = [(weight[kind, i], votes >> i & 1) for i in voters[votes]]
        post[kind, votes] = sum(w * yes for w, yes in own) / sum(w for w, _ in own)
    for _ in range(rounds):
        for kind in range(len(KINDS)):
            own = [k for k in counts if k[0] == kind]
            true, false = sum(counts[k] * post[k] for k in own), sum(counts[k] * (1 - post[k]) for k in own)
            share = (true + 1) / (true + false + 2)
            rates = []
            for i in labelers:
                voted = [k for k in own if i in voters[k[1]]]
                yes = [k for k in voted if k[1] >> i & 1]
                t, f = sum(counts[k] * post[k] for k in voted), sum(counts[k] * (1 - post[k]) for k in voted)
                a, b = sum(counts[k] * post[k] for k in yes), sum(counts[k] * (1 - post[k]) for k in yes)
                hit, alarm = (a + 8) / (t + 10), (b + 2) / (f + 10)
                hit = max(hit, RULE_HITS) if LABELERS[i] == "rule" else hit
                rates.append((hit, alarm) if hit >= alarm else ((a + b + 10) / (t + f + 20),) * 2)
            for k in own:
                log = math.log(share / (1 - share))
                for i in voters[k[1]]:
                    hit, alarm = rates[i]
                    log += math.log(hit / alarm if k[1] >> i & 1 else (1 - hit) / (1 - alarm))
                post[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
    return post


def classifier(counts: dict[tuple[int, int], int], post: dict[tuple[int, int], float], steps: int = 300, rate: float = 1.0) -> list[list[float]]:
    """For each kind the weights of votes and features, and last a constant: logistic, fitted to the posteriors span by span."""
    out = []
    for kind in range(len(KINDS)):
        rows = [([float(b >> i & 1) for i in range(BITS)] + [1.0], n, post[kind, b & VOTES]) for (k, b), n in counts.items() if k == kind]
        total, weights = sum(n for _, n, _ in rows) or 1, [0.0] * (BITS + 1)
        for _ in range(steps):
            gradient = [1e-3 * w for w in weights]
            for x, n, y in rows:
                z = sum(w for w, v in zip(weights, x) if v)
                error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * n / total
                gradient = [g + error * v for g, v in zip(gradient, x)]
            weights = [w - rate * g for w, g in zip(weights, gradient)]
        out.append(weights)
    return out


def find_personal_data(
    docs: DataFrame, text: str = "text", keep: Iterable[str] | None = None, threshold: float = 0.8, redacted: bool = False
) -> DataFrame:
    """Personal data in every whole text: the contract's spans, and others that a classifier accepts.

    Five labelers vote on every candidate span, those included that fail the
    contract: the strict rule, a gazetteer, the words before it, its shape and
    how it is written; the first three may abstain. One pass counts the patterns
    of votes and of six features of the span and its neighbourhood (at most
    16,384 a kind) over all documents;
    expectation-maximisation over the votes estimates how reliable each labeler
    is, and for each kind a logistic classifier over votes and features is
    fitted to the posteriors. A second pass keeps the strict spans, and adds
    candidates that the classifier gives ``threshold`` or more, as kinds
    email_like, ip_like, card_like, phone_like.

    Returns ``keep`` (all input columns by default), n_email, n_ip, n_card,
    n_phone (strict spans), n_added, base_sha256, spans, found (kind, start,
    end; code points, end exclusive), and with ``redacted`` the text with a tag
    in place of each span as redacted_text; they replace input columns of these
    names. A null text counts as empty and is redacted to null. Repeated rows
    have the same result; an empty table gives an empty result.
    """
    new = (*(f"n_{k}" for k in KINDS), "n_added", "base_sha256", "spans", "found", "redacted_text")
    own = carried(docs, keep, new)
    whole = F.coalesce(F.col("t"), F.lit(""))
    seen = docs.select(quoted(text).alias("t")).select(F.explode(candidates(whole)).alias("x"))
    counts = {(r[0], r[1]): r[2] for r in seen.groupBy("x.kind", "x.bits").count().collect()}
    votes: dict[tuple[int, int], int] = {}
    for (kind, b), n in counts.items():
        votes[kind, b & VOTES] = votes.get((kind, b & VOTES), 0) + n
    weights = classifier(counts, reliabilities(votes))
    of_kind = lambda x, i: F.element_at(F.array(*[F.lit(w[i]) for w in weights]), x["kind"] + 1)
    least = math.log(threshold / (1 - threshold))

    def accepted(x: Column) -> Column:
        total = of_kind(x, BITS)
        for i in range(BITS):
            total = total + F.when(x["bits"].bitwiseAND(1 << i) != 0, of_kind(x, i)).otherwise(0.0)
        return total >= least

    rows = docs.select(*[quoted(c).alias(f"in_{c}") for c in own], quoted(text).alias("t")).withColumn("every", candidates(whole))
    taken = F.filter("every", lambda x: x["strict"] | accepted(x))
    names = F.array(*[F.lit(k) for k in (*KINDS, *ADDED)])
    place = lambda x: x["kind"] + F.when(x["strict"], 0).otherwise(len(KINDS))
    ordered = F.array_sort(F.transform(taken, lambda x: F.struct(place(x).alias("k"), x["start"].alias("start"), x["end"].alias("end"))))
    rows = rows.withColumn("taken", ordered)
    named = lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    listed = lambda spans: F.array_join(F.transform(spans, named), ",")
    is_kind = lambda i: lambda x: x["k"] == i
    count = lambda test: F.size(F.filter("taken", test)).cast("long")
    out = [
        *[count(is_kind(i)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        count(lambda x: x["k"] >= len(KINDS)).alias("n_added"),
        F.sha2(listed(F.filter("taken", lambda x: x["k"] < len(KINDS))), 256).alias("base_sha256"),
        listed(F.col("taken")).alias("spans"),
        F.transform("taken", lambda x: F.struct(F.element_at(names, x["k"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("found"),
    ]
    if redacted:
        by_start = F.array_sort(F.transform("taken", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["k"].alias("k"))))

        def cut(acc: Column, x: Column) -> Column:
            tag = F.concat(F.lit("["), F.upper(F.element_at(names, x["k"] + 1)), F.lit("]"))
            more = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substr("t", acc["at"] + 1, x["start"] - acc["at"]), tag)).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), more.alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        rest = F.aggregate(by_start, start, cut, lambda acc: F.concat(acc["out"], F.substr("t", acc["at"] + 1)))
        out.append(F.when(F.size("taken") == 0, F.col("t")).otherwise(rest).alias("redacted_text"))
    return rows.select(*[quoted(f"in_{c}").alias(c) for c in own], *out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read(spark, sf_dir, "documents"), keep=["doc_id"]).drop("found")


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the contract's patterns alone find, for the comparison with SQL."""
    return query(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256")


BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT r, 0 AS k, 'email' AS kind, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS gaps,
    regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS ms FROM d
  UNION ALL SELECT r, 1, 'ip', string_split_regex(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d
  UNION ALL SELECT r, 2, 'card', string_split_regex(t, '[0-9]([\x20-]?[0-9])+'), regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+') FROM d
  UNION ALL SELECT r, 3, 'phone', string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM d),
e AS (SELECT r, k, kind, i, gaps[i] AS gap, ms[i] AS m FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM f)),
s AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY r, k ORDER BY i) AS z, regexp_replace(m, '[^0-9]', '', 'g') AS n FROM e),
x AS (SELECT r, k, kind, CAST(z - length(m) AS BIGINT) AS a, CAST(z AS BIGINT) AS z FROM s WHERE CASE k
  WHEN 0 THEN true
  WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda v: length(ltrim(v, '0')) > 3 OR coalesce(TRY_CAST(ltrim(v, '0') AS BIGINT), 0) > 255)) = 0
  WHEN 2 THEN length(n) BETWEEN 16 AND 19 AND list_sum(list_transform(generate_series(0, length(n) - 1), lambda j: CASE
      WHEN j % 2 = 0 THEN CAST(n[length(n) - j] AS INTEGER)
      ELSE 2 * CAST(n[length(n) - j] AS INTEGER) // 10 + 2 * CAST(n[length(n) - j] AS INTEGER) % 10 END)) % 10 = 0
  ELSE length(n) BETWEEN 8 AND 15 END),
n AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_email, count(*) FILTER (WHERE k = 1) AS n_ip, count(*) FILTER (WHERE k = 2) AS n_card,
  count(*) FILTER (WHERE k = 3) AS n_phone, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY k, a) AS listed FROM x GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(listed, '')) AS base_sha256
FROM d LEFT JOIN n USING (r)
"""
