"""Quality rules with thresholds that adapt to each language and source.

Counts of each document become integer rates. Each rate goes into a mergeable
quantile sketch: a log-linear histogram that keeps a value's SIGNIFICANT
leading bits, so that a quantile is off by at most 1/2^(SIGNIFICANT-1) of
itself, and two sketches are merged by adding counts. Sketches are kept per
(lang, source, rate) as rows, are merged upward to languages and to the whole
corpus, and give the quantiles at each level. Those of a group are blended with
those of its language, and these with those of the corpus, in proportion to the
rows behind them: the level above counts as much as LEAN rows, so that a small group
leans on it and a large one stands for itself.

Rates that every document has (DENSE) are fenced SPREADS interquartile ranges
beyond the blended quartiles. Rates that most documents have at zero (SPARSE)
have no spread between quartiles. Their level is the blended USUAL percentile
among the documents that pass the base rules and the dense fences, and a
document fails if it has more occurrences than that level gives a text of its
length, by SPREADS standard deviations of such a count, that of a single one at
least. So a few marks in a group without any, or in a long text, are no fault.
Documents are joined with their group's fences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stage

ship(__name__)

SIGNIFICANT, SPREADS, LEAN, USUAL, REPEAT_WINDOW = 6, 3, 100, 95, 8
RATES = ["symbol_rate", "repeat_rate", "dup_line_rate", "upper_rate", "mark_rate", "word_length"]
#: Rates with fences from quartiles: an upper one, and for word_length a lower one too.
DENSE = ["upper_rate", "word_length"]
#: Rates in 10,000 of a count among others: what is counted, among what, and how many of it make one occurrence.
SPARSE = {
    "symbol_rate": ("n_symbols", "n_words", 1),
    "repeat_rate": ("n_repeat_words", "n_words", 2 * REPEAT_WINDOW),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1),
    "mark_rate": ("n_marks", "n_words", 1),
}
_BLANKS, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks"]


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words in windows that occur twice or more, found by numbering windows of 1, 2, 4 and 8 words exactly."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    size = 1
    while size < window:
        _, ids = np.unique(ids[:-size] * (int(ids.max()) + 1) + ids[size:], return_inverse=True)
        size *= 2
    twice = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[window:] -= twice
    return int((np.cumsum(edges)[:-1] > 0).sum())


def counts(data: bytes | None) -> list[int]:
    """COUNTS of a whole text."""
    data = data or b""
    words = data.split()
    if not words:
        return [0] * len(COUNTS)
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    total = lambda chars: int(n[list(chars)].sum())
    lines = [x for x in data.split(b"\n") if x.strip(_BLANKS)]
    upper = int(n[65:91].sum())
    return [
        len(words),
        len(data) - int(n[128:192].sum()) - total(_BLANKS),
        total(_SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        upper + int(n[97:123].sum()),
        total(b"!?"),
    ]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([counts(x) for x in batch["data"].to_pylist()], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], batch["source"], *(pa.array(found[:, i]) for i in range(len(COUNTS)))], ["doc_id", "lang", "source", *COUNTS])


def sketches(rates: DataFrame, names: list[str]) -> DataFrame:
    """(lang, source, rate, value, n): the sketch of each group as rows; `rates` has lang, source and the columns `names`."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).cast("long").alias("v")) for r in names]))
    each = rates.select("lang", "source", each.alias("x")).select("lang", "source", "x.*")
    cut = F.greatest(F.lit(0), F.length(F.bin("v")) - SIGNIFICANT).cast("int")
    each = each.withColumn("cut", cut).withColumn("value", F.expr("shiftleft(shiftright(v, cut), cut)"))
    return each.groupBy("lang", "source", "rate", "value").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, group: list[str], percents: list[int]) -> DataFrame:
    """(group, rate, n, q<percent>...) from sketch rows, merged over the columns that `group` leaves out. A sketch has a bounded number of values."""
    merged = sketch.groupBy(*group, "rate", "value").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*group, "rate")
    upto = F.sum("n").over(by.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    merged = merged.select(*group, "rate", "value", upto.alias("upto"), F.sum("n").over(by).alias("all"))
    at = [F.min(F.when(F.col("upto") * 100 >= F.col("all") * p, F.col("value"))).alias(f"q{p}") for p in percents]
    return merged.groupBy(*group, "rate").agg(F.max("all").alias("n"), *at)


def levels(groups: DataFrame, sketch: DataFrame, names: list[str], percents: list[int]) -> DataFrame:
    """(lang, source, <rate>_q<percent>...): blended quantiles for each row of `groups` (lang, source), also where the sketch has none of it."""
    struct = F.struct("n", *[f"q{p}" for p in percents])
    own, lang, whole = (quantiles(sketch, g, percents) for g in (["lang", "source"], ["lang"], []))
    each = groups.select("lang", "source", F.explode(F.array(*[F.lit(r) for r in names])).alias("rate"))
    each = each.join(own.select("lang", "source", "rate", struct.alias("own")), ["lang", "source", "rate"], "left")
    each = each.join(lang.select("lang", "rate", struct.alias("of_lang")), ["lang", "rate"], "left")
    each = each.join(F.broadcast(whole.select("rate", struct.alias("of_all"))), "rate", "left")  # a row for each rate

    def blend(level: str, q: str, above: Column) -> Column:
        n, value = (F.coalesce(F.col(f"{level}.{c}"), F.lit(0)) for c in ("n", q))
        return (n * value + LEAN * above) / (n + LEAN)

    found = {f"q{p}": blend("own", f"q{p}", blend("of_lang", f"q{p}", F.coalesce(F.col(f"of_all.q{p}"), F.lit(0)))) for p in percents}
    each = each.select("lang", "source", "rate", *[c.alias(q) for q, c in found.items()])
    pick = [F.max(F.when(F.col("rate") == r, F.col(q))).alias(f"{r}_{q}") for r in names for q in found]
    return each.groupBy("lang", "source").agg(*pick)


def beyond_quartiles(rate: str) -> Column:
    """Whether a dense rate lies beyond its fences."""
    room = SPREADS * (F.col(f"{rate}_q75") - F.col(f"{rate}_q25"))
    high = F.col(rate) > F.col(f"{rate}_q75") + room
    return high | (F.col(rate) < F.col(f"{rate}_q25") - room) if rate == "word_length" else high


def beyond_usual(rate: str) -> Column:
    """Whether there are more occurrences than a sparse rate's usual level gives a text of this length."""
    count, among, unit = SPARSE[rate]
    usual = F.col(f"{rate}_q{USUAL}") / 10000 * F.col(among) / unit
    return F.col(count) / unit > usual + SPREADS * F.sqrt(usual + 1)


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS, RATES, base_failed, failed, kept) of every row of `docs`.

    `failed` lists the rates beyond their fences. Null texts have no words and
    fail the base rules; null languages and sources form groups of their own.
    Repeated rows count as often as they occur.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c)  # noqa: E731  null is another group than an empty name
    rows = docs.select("doc_id", name("lang"), name("source"), F.col("text").cast("binary").alias("data"))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(_counted, f"doc_id {doc_id}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    share = lambda a, b, scale: F.expr(f"{a} * {scale} div greatest({b}, 1)")
    rates = {rate: share(count, among, 10000) for rate, (count, among, _) in SPARSE.items()}
    rates |= {"upper_rate": share("n_upper", "n_letters", 10000), "word_length": share("word_chars", "n_words", 100)}
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = stage(rows.withColumns(rates).withColumn("base_failed", base), "counts")
    groups = stage(rows.select("lang", "source").distinct(), "groups")
    dense = stage(levels(groups, sketches(rows, DENSE), DENSE, [25, 75]), "dense")
    rows = rows.join(dense, ["lang", "source"])
    normal = rows.where(~F.col("base_failed") & ~beyond_quartiles(DENSE[0]) & ~beyond_quartiles(DENSE[1]))
    sparse = stage(levels(groups, sketches(normal, list(SPARSE)), list(SPARSE), [USUAL]), "sparse")
    rows = rows.join(sparse, ["lang", "source"])
    beyond = [F.when(beyond_quartiles(r) if r in DENSE else beyond_usual(r), F.lit(r)) for r in RATES]
    out = rows.withColumn("failed", F.array_compact(F.array(*beyond)))
    kept = ~F.col("base_failed") & (F.size("failed") == 0)
    return out.select("doc_id", *COUNTS, *RATES, "base_failed", F.array_join("failed", ",").alias("failed"), kept.alias("kept"))
