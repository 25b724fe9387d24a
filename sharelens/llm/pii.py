"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose candidate spans. Four labelers vote yes, no or nothing on
each: its format (check digits, ranges), gazetteers (top-level domains, issuer
digits, country codes), the words before it, and its shape. Expectation-
maximisation over the counts of vote patterns estimates how reliable each
labeler is and how likely each candidate is to be real; with these soft labels
a logistic classifier of span features is trained, which decides on the
candidates that the base rules don't settle. Spans that pass the base rules
always stay.

The patterns are written so that a match takes time in proportion to its
length: possessive, and starting only where a run starts.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_totals, stage

KINDS = ["email", "ip", "card", "phone", "secret"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,64}+(?![A-Za-z0-9])",
}
#: A text without this has no match, so the pattern isn't tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "secret": "[0-9a-f]{32}"}
# Gazetteers and the words that announce a kind.
DOMAINS = ["com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "io", "info"]
COUNTRY_CODES = ["1", "33", "34", "39", "44", "49"]
BEFORE = {"email": "mail|contact|write", "ip": "ip|host|addr|server", "card": "card|visa|credit|account", "phone": "tel|phone|call|fax|mobil", "secret": "token|key|secret|passw|api"}
LABELERS = ["format", "gazetteer", "context", "shape"]
CUT, ROUNDS = 0.5, 30
#: Prior rates of each vote for real and for other candidates; True: the format labeler.
PRIOR_RATES = {True: {-1: (0.01, 0.7), 0: (0.01, 0.01), 1: (0.98, 0.29)}, False: {-1: (0.2, 0.5), 0: (0.3, 0.3), 1: (0.5, 0.2)}}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def _format_ok(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    return {
        "email": F.lit(True),
        "ip": m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"),
        "card": n.between(16, 19) & F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(False),
        "phone": n.between(8, 15),
        "secret": F.lit(True),
    }[kind]


def _votes(kind: str, m: Column, before: Column) -> list[Column]:
    vote = lambda yes: F.when(yes, 1).otherwise(-1)
    length, n = F.length(m), F.length(_digits(m))
    gazetteer = {
        "email": vote(F.lower(F.substring_index(m, ".", -1)).isin(DOMAINS)),
        "ip": vote(m.rlike(r"^0*(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.")),
        "card": vote(m.rlike("^[3-6]")),
        "phone": vote(m.rlike(r"^\+(?:" + "|".join(COUNTRY_CODES) + ")")),
        "secret": F.lit(0),
    }[kind]
    context = F.when(F.lower(before).rlike(f"(?:{BEFORE[kind]})[^A-Za-z0-9]*$"), 1).when(before.rlike(r"[A-Za-z0-9.]$"), -1).otherwise(0)
    shape = {
        "email": vote(length.between(6, 64)),
        "ip": vote(length.between(7, 15)),
        "card": vote(m.rlike(r"^[0-9]{16,19}$") | m.rlike(r"^(?:[0-9]{4}[\x20-]){3}[0-9]{4}$")),
        "phone": vote(length.between(10, 20)),
        "secret": vote(length.isin(32, 40, 48, 56, 64)),
    }[kind]
    return [vote(_format_ok(kind, m)), gazetteer, context, shape]


def _features(kind_at: int, m: Column, before: Column) -> Column:
    """Span features for the classifier, coarse enough that few distinct ones exist."""
    length, n = F.least(F.length(m), F.lit(80)), F.least(F.length(_digits(m)), F.lit(40))
    kind = [F.lit(1 if i == kind_at else 0) for i in range(len(KINDS))]
    seps = F.least(F.length(m) - F.length(F.regexp_replace(m, r"[\x20().:@-]", "")), F.lit(8))
    return F.array(*kind, length, n, F.abs(n - 16), F.when(_format_ok(KINDS[kind_at], m), 1).otherwise(0), seps, F.when(before.rlike(r"[A-Za-z0-9]$"), 1).otherwise(0), F.when(before.rlike(r"[=:\x22]\s*$"), 1).otherwise(0)).cast("array<int>")


def _spans(at: int, both: Column) -> Column:
    """Span structs of one kind from (text before, match) pairs in order."""
    kind = KINDS[at]

    def span(x: Column, begin: Column) -> Column:
        before = F.right(x["part"], F.lit(24))
        base = F.lit(kind != "secret") & _format_ok(kind, x["hit"])
        return F.struct(F.lit(at).alias("kind"), begin.alias("start"), (begin + F.length(x["hit"])).alias("end"), base.alias("base"), F.array(*_votes(kind, x["hit"], before)).alias("votes"), _features(at, x["hit"], before).alias("features"))

    ends = running_totals(F.transform(both, lambda x: (F.length(x["part"]) + F.length(x["hit"])).cast("long")))
    return F.zip_with(both, F.zip_with(both, ends, lambda x, end: end - F.length(x["hit"])), span)


def candidates(text: Column) -> Column:
    """All candidate spans of a text: array<struct<kind,start,end,base,votes,features>>, by kind, then start."""
    found = []
    for at, kind in enumerate(KINDS):
        parts, hits = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        both = F.array(F.zip_with(parts, hits, lambda p, m: F.struct(p.alias("part"), m.alias("hit"))))  # one array in an array: the lambdas below bind it, so it is made once
        matched = F.transform(both, lambda x: F.filter(x, lambda y: y["hit"].isNotNull()))  # the piece after the last match goes
        found.append(F.when(text.rlike(NEEDS[kind]), F.get(F.transform(matched, _each(at)), 0)))
    empty = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:array<int>,features:array<int>>>"
    return F.concat(*[F.coalesce(x.cast(empty), F.array().cast(empty)) for x in found])


def _each(at: int):
    return lambda both: _spans(at, both)


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, tuple[int, ...]], float]:
    """EM over (kind, votes, count): the chance that a candidate with these votes is real.

    Labelers are independent given the truth; each kind has its own rates. At
    most 3^4 patterns a kind exist, whatever the input.
    """
    real = {(k, v): 0.05 if v[0] < 0 else 0.95 if sum(v) > 0 else 0.5 for k, v, _ in patterns}  # the start leans on the format
    for _ in range(rounds):
        share, rate = {}, {}
        for k in {k for k, _, _ in patterns}:
            rows = [(v, n, real[k, v]) for kk, v, n in patterns if kk == k]
            yes, all_ = sum(n * p for _, n, p in rows), sum(n for _, n, _ in rows)
            share[k] = (yes + 1) / (all_ + 2)
            for j in range(len(LABELERS)):
                for vote in (-1, 0, 1):
                    hit = [(n * p, n * (1 - p)) for v, n, p in rows if v[j] == vote]
                    weight = all_ if j == 0 else 3  # a check digit or range is believed as much as all that is counted, the others hardly
                    lean, back = PRIOR_RATES[j == 0][vote]
                    rate[k, j, vote] = ((sum(a for a, _ in hit) + weight * lean) / (yes + weight), (sum(b for _, b in hit) + weight * back) / (all_ - yes + weight))
        for k, v, _ in patterns:
            odds = math.log(share[k] / (1 - share[k])) + sum(math.log((rate[k, j, x][0] + 1e-6) / (rate[k, j, x][1] + 1e-6)) for j, x in enumerate(v))
            real[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return real


def train(found: DataFrame) -> tuple[list[float], float] | None:
    """(weights, intercept) of the span classifier from `found` (spans array); None without candidates."""
    spark = found.sparkSession
    groups = found.select(F.explode("spans").alias("s")).groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"), F.col("s.features").alias("features")).agg(F.count("*").alias("n"))
    groups = stage(groups, "patterns")
    counted = groups.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    if not counted:
        return None
    real = reliabilities(sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in counted))
    soft = spark.createDataFrame([(k, list(v), p) for (k, v), p in real.items()], "kind int, votes array<int>, p double")
    rows = groups.join(F.broadcast(soft), ["kind", "votes"]).groupBy("features").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
    rows = rows.select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("yes").alias("w")), F.struct(F.lit(0.0).alias("label"), F.col("no").alias("w")))).alias("x"))
    rows = rows.select(array_to_vector(F.col("features").cast("array<double>")).alias("features"), "x.label", F.greatest("x.w", F.lit(1e-3)).alias("w"))
    model = LogisticRegression(weightCol="w", regParam=1e-3, maxIter=40).fit(stage_rows(rows))
    return [float(x) for x in model.coefficients], float(model.intercept)


def stage_rows(rows: DataFrame) -> DataFrame:
    """The few training rows, cut from their lineage."""
    from .common import shared_dir

    shared_dir(rows.sparkSession)
    return rows.coalesce(2).checkpoint()


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row of `docs`.

    Null and empty texts have no spans. Repeated rows count as often as they
    occur when labelers are weighed, and get equal spans. Offsets are code points.
    """
    found = stage(docs.select("doc_id", candidates(F.coalesce("text", F.lit(""))).alias("spans")), "spans")
    model = train(found)
    if model is None:
        likely = lambda s: F.lit(False)
    else:
        weights = F.array(*[F.lit(x) for x in model[0]])
        raw = lambda s: F.aggregate(F.zip_with(s["features"], weights, lambda x, w: x * w), F.lit(model[1]), lambda a, x: a + x)
        likely = lambda s: raw(s) >= math.log(CUT / (1 - CUT))
    names = F.array(*[F.lit(k) for k in KINDS])
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base, kept = F.filter("spans", lambda s: s["base"]), F.filter("spans", lambda s: s["base"] | likely(s))
    number = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == KINDS.index(k)))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[number(k) for k in KINDS[:4]], F.sha2(show(base), 256).alias("base_sha256"), show(kept).alias("spans"), (F.size(kept) - F.size(base)).cast("long").alias("n_added"))
