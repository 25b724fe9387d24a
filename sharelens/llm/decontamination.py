"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `window` consecutive words of each benchmark item
(an item with fewer words is one window). They are grouped by length; each
group has a table that says, for a block of two words, how far the search may
shift before a window can end, and buckets of windows under the hash of their
last block. A block in no window shifts past all positions it rules out; a
block that ends a window selects that bucket's windows, which are compared
directly.

The tables go to every task in parts of at most PART_WINDOWS windows, so the
memory they take has a bound whatever the benchmark's size; the documents are
searched once for each part and the hits are joined.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, ship, stage, table

ship(__name__)

WINDOW = 10
PART_WINDOWS = 200_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Word bytes stay (A-Z lower-cased), all others become blanks.
_FOLD = bytes(_LOWER[c] if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(_FOLD).split() if data else []


def item_windows(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    size = min(window, len(words))
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] if words else []


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, data in zip(batch["item_id"].to_pylist(), batch["data"].to_pylist()):
            found = sorted({b" ".join(w) for w in item_windows(words_of(data), window)})
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], ["item", "pattern"])


class Patterns:
    """Wu-Manber tables over words for the windows of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length, self.block = length, min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[list[bytes], list[str]]]] = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.skip), length - end)
            self.bucket[words[-self.block :]].append((list(words), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, items) of every occurrence."""
        at, n, length, block = self.length, len(words), self.length, self.block
        shift, skip = self.shift, self.skip
        while at <= n:
            key = tuple(words[at - block : at])
            step = shift.get(key, skip)
            if step:
                at += step
                continue
            for pattern, items in self.bucket[key]:
                if words[at - length : at] == pattern:
                    yield at - length, items
            at += 1


def _tables(rows: list[tuple[bytes, list[str]]]) -> list[Patterns]:
    by_length: dict[int, dict] = defaultdict(dict)
    for pattern, items in rows:
        words = tuple(pattern.split(b" "))
        by_length[len(words)][words] = items
    return [Patterns(n, found) for n, found in sorted(by_length.items())]


def _spans(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint [start, end) that cover the given ones."""
    out: list[list[int]] = []
    for lo, hi in sorted(starts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _result(n_words: list, spans: list[list[tuple[int, int]]], items: list[set[str]]) -> list[pa.Array]:
    hit = [sum(hi - lo for lo, hi in s) for s in spans]
    return [
        pa.array(n_words, pa.int64()),
        pa.array(hit, pa.int64()),
        pa.array([len(x) for x in items], pa.int64()),
        pa.array([_digest(list(x)) for x in items], pa.string()),
        pa.array([x > 0 for x in hit], pa.bool_()),
    ]


NAMES = ["doc_id", "_d", "_h", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
RESULT = "_d long, _h long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_windows: int = PART_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of `docs`; see `searched`."""
    return searched(docs, benchmark, window, part_windows).drop("_d", "_h")


def searched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_windows: int = PART_WINDOWS) -> DataFrame:
    """(doc_id, _d, _h, n_words, n_hit, n_items, items_sha256, contaminated) of every row of `docs`; _d and _h name a row (see common).

    Null and word-less texts have no words and no hits; a null or word-less
    item has no window; items that repeat an item_id are one item, and those
    without an id share the id "". Rows equal in doc_id and text get equal
    results.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("data")).where("data IS NOT NULL")
    windows = items.mapInArrow(lambda x: _windows(x, window), "item string, pattern binary")
    windows = windows.groupBy("pattern").agg(F.collect_set("item").alias("items"))
    n_windows = (windows := stage(windows, "windows")).count()
    parts = max(1, -(-n_windows // part_windows))
    data = docs.select("doc_id", F.col("text").cast("binary").alias("data"), *row_key())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def tables(part: int):
        rows = windows.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part) if parts > 1 else windows
        return spark.sparkContext.broadcast([(r["pattern"], r["items"]) for r in rows.collect()])

    def hits(batches: Iterator[pa.RecordBatch], shared) -> Iterator[tuple]:
        groups = _tables(shared.value)
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in batch["data"].to_pylist():
                words = words_of(text)
                found, names = [], set()
                for group in groups:
                    for start, ids in group.search(words):
                        found.append((start, start + group.length))
                        names.update(ids)
                n_words.append(len(words))
                spans.append(_spans(found))
                items.append(names)
            yield batch, n_words, spans, items

    if parts == 1:
        shared = tables(0)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, n_words, spans, items in hits(batches, shared):
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in NAMES[:3]), *_result(n_words, spans, items)], NAMES)

        return data.mapInArrow(whole, f"doc_id {kind}, {RESULT}")

    found = None
    for part in range(parts):
        shared = tables(part)

        def some(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, _, spans, items in hits(batches, shared):
                take = [i for i, s in enumerate(spans) if s]
                pairs = pa.array([[{"lo": lo, "hi": hi} for lo, hi in spans[i]] for i in take], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch["_d"].take(pa.array(take, pa.int64())), batch["_h"].take(pa.array(take, pa.int64())), pairs, pa.array([sorted(items[i]) for i in take], pa.list_(pa.string()))], ["_d", "_h", "spans", "items"])

        rows = stage(data.mapInArrow(some, "_d long, _h long, spans array<struct<lo:long,hi:long>>, items array<string>").dropDuplicates(["_d", "_h"]), "hits")
        found = rows if found is None else found.unionByName(rows)
    found = found.groupBy("_d", "_h").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_spans([(x["lo"], x["hi"]) for x in s or []]) for s in batch["spans"].to_pylist()]
            items = [set(x or []) for x in batch["items"].to_pylist()]
            n_words = [len(words_of(x)) for x in batch["data"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in NAMES[:3]), *_result(n_words, spans, items)], NAMES)

    rows = data.join(found, ["_d", "_h"], "left").select("doc_id", "_d", "_h", "data", "spans", "items")
    return rows.mapInArrow(joined, f"doc_id {kind}, {RESULT}")


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a window of any benchmark item.

    A row goes by its own text: rows equal in doc_id and text go together, other
    rows of the same doc_id stay if they are clean, and so do rows without
    doc_id. Null and empty texts are clean.
    """
    bad = searched(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    bad = bad.select(F.col("_d").alias("_bad_d"), F.col("_h").alias("_bad_h")).distinct()
    d, h = row_key()
    return docs.join(bad, (d == F.col("_bad_d")) & (h == F.col("_bad_h")), "left_anti").select(*docs.columns)
