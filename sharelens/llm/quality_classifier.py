"""Bradley-Terry quality ranking: document scores learned from preference pairs.

Features are counts over the whole text as rates. Every labelled document is
held against some of the other kind drawn by a seeded hash, the low ones
preferred less; the logistic loss on the feature differences gives the weights of
the score. The cut is a quantile of the scores: the share of low documents among
the training rows. All labelled rows outside the held-out third are training
rows; only their features, not their texts, are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scans import exact_percentiles
from .common import likely_in, ship, stage, table
from .training import held_out, labels_of

ship(__name__)

#: Documents of the other kind that one of the commoner kind is compared with, on average; one of the rarer kind is compared with more.
OPPONENTS = 8
REG = 1e-3
N_FEATURES = 13
_bytes = lambda chars: np.frombuffer(chars, np.uint8)
SYMBOLS, BLANK, UPPER, LOWER, DIGIT = _bytes(b"#*$%&|<>"), _bytes(b" \t\n\x0b\x0c\r"), slice(65, 91), slice(97, 123), slice(48, 58)


def features(text: str | None) -> list[float]:
    """Rates that describe a text; all but the first are zero for an empty or null one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * N_FEATURES
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars, count = int(n.sum() - n[128:192].sum()), len(words)
    letters = max(1, int(n[UPPER].sum() + n[LOWER].sum()))
    return [
        np.log1p(count),
        (chars - int(n[BLANK].sum())) / count / 10,
        min(1.0, int(n[SYMBOLS].sum()) / count),
        min(1.0, int(n[SYMBOLS].sum()) / count * 20),
        int(n[UPPER].sum()) / letters,
        min(1.0, int(n[33]) / count),
        min(1.0, int(n[124]) / count),
        min(1.0, int(n[DIGIT].sum()) / chars),
        len(set(words)) / count,
        1 - len(set(lines)) / len(lines),
        min(1.0, int(n[46]) / count * 5),
        min(1.0, int(n[44]) / count * 5),
        min(1.0, len(lines) / count * 5),
    ]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(x) for x in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], pa.array(found, pa.list_(pa.float64()))], ["doc_id", "h", "f"])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y, f): the features of every labelled document outside the held-out third; of several texts of a doc_id that of the smallest hash."""
    ids = stage(labels_of(labels, "quality", "min"), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("doc_id").isNotNull() & ~held_out())
    texts = likely_in(texts, "doc_id", ids).select("doc_id", F.xxhash64("text").alias("h"), "text")
    rows = texts.mapInArrow(_featured, "doc_id long, h long, f array<double>").groupBy("doc_id").agg(F.min(F.struct("h", "f")).alias("m"))
    return stage(rows.join(ids, "doc_id").select("doc_id", "y", "m.f"), "features")


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[float], float]:
    """(weights, cut) of the score w·f(text) - cut. Without labels of both kinds nothing can be compared: weights are 0 and every score 0.5."""
    rows = training_rows(docs, labels)
    counts = {r["y"]: r["n"] for r in rows.groupBy((F.col("y") >= 1).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    low, high = counts.get(0, 0), counts.get(1, 0)
    if not low or not high:
        return [0.0] * N_FEATURES, 0.0
    buckets = max(1, min(low, high) // 2)  # each holds some of both kinds
    lost = rows.where("y < 1").select(F.explode(F.sequence(F.lit(1), F.lit(max(1, OPPONENTS // 2)))).alias("turn"), "doc_id", F.col("f").alias("fl"))
    lost = lost.select(F.pmod(F.xxhash64("doc_id", "turn"), F.lit(buckets)).alias("bucket"), "doc_id", "fl")
    won = rows.where("y >= 1").select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), F.col("doc_id").alias("won"), F.col("f").alias("fh"))
    side = F.when(F.xxhash64("doc_id", "won") % 2 == 0, 1.0).otherwise(-1.0)
    pairs = lost.join(won, "bucket").withColumn("side", side)
    pairs = pairs.select(((F.col("side") + 1) / 2).alias("label"), F.zip_with("fh", "fl", lambda x, y: (x - y) * F.col("side")).alias("diff"))
    pairs = stage(pairs, "pairs").select("label", array_to_vector("diff").alias("features"))
    if pairs.select("label").distinct().count() < 2:
        return [0.0] * N_FEATURES, 0.0
    model = LogisticRegression(fitIntercept=False, regParam=REG, maxIter=40).fit(pairs)
    weights = [float(x) for x in model.coefficients]
    raw = F.aggregate(F.zip_with("f", F.array(*[F.lit(x) for x in weights]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    cut = exact_percentiles(rows.select(raw.alias("raw")), "raw", [], {"cut": low / (low + high)}).first()[0]
    return weights, float(cut)


def score_quality(docs: DataFrame, model: tuple[list[float], float], column: str = "score") -> DataFrame:
    """`docs` with `column`, 0 to 1, from `text` alone; a null text counts as empty. A column of that name is replaced."""
    weights, cut = np.array(model[0]), model[1]
    docs = docs.drop(column)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch["text"].to_pylist()]).reshape(-1, N_FEATURES)
            score = 1 / (1 + np.exp(-np.clip(x @ weights - cut, -50, 50)))
            yield batch.append_column(column, pa.array(score, pa.float64()))

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`, repeated rows and null texts included."""
    model = train(docs, labels)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of 0.5 or more."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, "_quality").where("_quality >= 0.5").select(*docs.columns)
