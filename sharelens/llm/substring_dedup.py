"""Substring dedup: windows of words that start in an earlier document too, by super-k-mer partitioning.

A window's minimiser is the group of GRAM successive words in it with the
smallest hash. Successive windows of a document mostly share it; such a run of
windows is a super-k-mer and travels as one string of packed words to the bucket
of its minimiser, where equal windows meet, as they have equal minimisers. A
bucket is sorted by window, and the smallest doc_id of each window is exact. Runs
whose minimiser is in one document only hold no shared window; a first pass over
the minimisers alone finds those that are in several; a bit filter of bounded
size spares most others the way, and the rest meet nothing in their buckets.

A minimiser with over HOT runs doesn't send them to one bucket. Its equal runs
become one row with the smallest and the largest doc_id before the shuffle, so
that copies of a passage, however many, don't meet in a task; and as a passage
in very many documents has as many different runs at its edges, their windows
travel apart from them: runs are dealt by hash over packs of bounded size, the runs of a pack that hold a window are one row,
and packs, not runs, are joined to the smallest doc_id of their window. What a pack's windows found goes back to its runs in the pack,
so that no task lists all runs of a window. A run is named by its minimiser and a 64-bit hash of its words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MISSING, flagged, likely_in, row_key, scratch, ship, stage

ship(__name__)

WINDOW, GRAM = 13, 6
#: Different runs of one minimiser that are still sorted together.
HOT = 256
#: Windows that a pack of hot runs holds on average.
PACK = 1 << 14
#: 64-bit words of the bit filter of shared minimisers: 32 Mbit, 4 MB, whatever the input.
FILTER = 1 << 19
_LAST = 2**63 - 1
_FILTER_BITS = FILTER.bit_length() - 1
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def runs(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of each super-k-mer of a document."""
    n = len(words) - window + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 3
    each = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    h = np.zeros(len(words) - gram + 1, np.uint64)
    for i in range(gram):
        h = (h ^ each[i : i + len(h)]) * _MUL
        h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    size, width, level = 1, window - gram + 1, h  # minima over spans that double
    while 2 * size <= width:
        level = np.minimum(level[:-size], level[size:])
        size *= 2
    least = np.minimum(level[:n], level[width - size : width - size + n])
    starts = np.concatenate(([0], np.nonzero(np.diff(least))[0] + 1))
    return least[starts].view(np.int64), starts, np.diff(np.append(starts, n))


def _minimisers(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, found = [], []
        for i, data in enumerate(batch["data"].to_pylist()):
            each = np.unique(runs((data or b"").split(), window, gram)[0])
            found.append(each)
            owner.append(np.full(len(each), i))
        if found:
            doc = batch["doc"].take(pa.array(np.concatenate(owner)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), doc], ["m", "doc"])


def _packed(batches: Iterator[pa.RecordBatch], window: int, gram: int, masks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The runs whose minimiser may be shared, by `masks`."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):  # runs are larger than their texts
            some = batch.slice(at, 64)
            owner, parts, strings = [], [], []
            for i, data in enumerate(some["data"].to_pylist()):
                words = (data or b"").split()
                m, start, n = runs(words, window, gram)
                u = m.view(np.uint64)
                near = (masks[u & np.uint64(FILTER - 1)] >> (u >> np.uint64(_FILTER_BITS) & np.uint64(63))) & np.uint64(1) > 0
                m, start, n = m[near], start[near], n[near]
                parts.append(np.stack([m, start, n]))
                owner.append(np.full(len(m), i))
                strings += [b" ".join(words[s : s + k + window - 1]) for s, k in zip(start.tolist(), n.tolist())]
            m, start, n = np.concatenate(parts, axis=1)
            keys = [some[c].take(pa.array(np.concatenate(owner))) for c in ("_d", "_h")]
            columns = [pa.array(m), pa.array(strings, pa.binary()), *keys, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["m", "run", "_d", "_h", "start", "n"])


def filter_of(keys: DataFrame) -> np.ndarray:
    """A bit for each of the long `m` of `keys`, by its low bits: FILTER words, of which some bits are of several keys."""
    m = F.col("m")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(m, _FILTER_BITS).bitwiseAND(63).cast("int"))
    found = keys.groupBy(m.bitwiseAND(FILTER - 1).alias("word")).agg(F.bit_or(bit).alias("mask")).toArrow()  # FILTER rows at most
    masks = np.zeros(FILTER, np.uint64)
    masks[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return masks


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """The windows of each row's `run` as `at` (0 for the first) and `words`, in place of it."""
    words = F.split(F.col("run").cast("string"), " ")
    each = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.array_join(F.slice(F.col("list"), i + 1, window), " "))
    kept = [c for c in rows.columns if c not in ("run", "n")]
    return rows.withColumn("list", words).select(*kept, F.posexplode(each).alias("at", "words"))


def met_windows(runs: DataFrame, window: int) -> DataFrame:
    """(m, pack, least, members array<struct<k, at, last>>): the windows of `runs` (m, k, doc, last, run, n) that start in several documents, with the smallest.

    A window has a row for each pack that has it, so that the rows joined don't grow with
    the runs it is in. A run's windows are all in one pack.
    """
    packs = 1 + (runs.agg(F.sum("n")).first()[0] or 0) // PACK
    member = F.collect_list(F.struct("k", "at", "last")).alias("members")
    packs = _windows(runs, window).groupBy("m", "words", F.pmod("k", F.lit(packs)).alias("pack")).agg(F.min("doc").alias("lo"), F.max("last").alias("hi"), member)
    # Written, so that the join reads it by a shuffle of its own and a hot window can be split.
    packs = stage(packs, "packs")
    least = packs.groupBy("m", "words").agg(F.min("lo").alias("least"), F.max("hi").alias("hi")).where("least < hi").drop("hi")
    return packs.join(stage(least, "least"), ["m", "words"]).select("m", "pack", "least", "members")


def by_run(met: DataFrame) -> DataFrame:
    """(m, k, early array<struct<at, least>>): what `met_windows` found that starts before a run's last document, a row for each run, not for each of its windows."""
    bound = lambda x, use: F.get(F.transform(F.array(x), use), F.lit(0))  # noqa: E731  made once, however often it is used
    own = F.transform(F.filter("members", lambda x: x["last"] > F.col("least")), lambda x: F.struct(x["k"].alias("k"), x["at"].alias("at"), F.col("least").alias("least")))
    whole = met.select("m", "pack", own.alias("own")).groupBy("m", "pack").agg(F.sort_array(F.flatten(F.collect_list("own"))).alias("own")).where(F.size("own") > 0)

    def cut(own: Column) -> Column:
        k = lambda i: F.get(own, i - 1)["k"]
        firsts = F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: (i == 1) | (k(i) != k(i - 1)))
        return bound(firsts, lambda at: F.transform(at, lambda i, j: F.slice(own, i, F.coalesce(F.get(at, j + 1), F.size(own) + 1) - i)))

    rows = whole.select("m", F.explode(bound(F.col("own"), cut)).alias("own"))
    return rows.select("m", F.get("own", F.lit(0))["k"].alias("k"), F.transform("own", lambda x: F.struct(x["at"].alias("at"), x["least"].alias("least"))).alias("early"))


def earliest(found: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(m, k, early array<struct<at, least>>): for the runs of `found`, which windows start in an earlier document than the run's last.

    `found` has m, run, its hash k, doc and n; m and k together name a run.
    """
    many = found.groupBy("m").agg(F.count("*").alias("rows")).where(F.col("rows") > hot).select("m")
    both = flagged(found.select("m", "k", "doc", "run", "n"), "m", stage(many, "hot"), "_hot")
    ends = [F.min("doc").alias("doc"), F.max("doc").alias("last"), F.first("run").alias("run"), F.first("n").alias("n")]
    # Few rows of a minimiser: its bucket is sorted by window.
    few = both.where("NOT _hot").drop("_hot").repartition("m").groupBy("m", "k").agg(*ends)
    few = _windows(few, window).withColumn("least", F.min("doc").over(Window.partitionBy("m", "words")))
    few = few.where("least < last").groupBy("m", "k").agg(F.collect_list(F.struct("at", "least")).alias("early"))
    # Many: equal runs are one row, their windows travel in packs.
    one = stage(both.where("_hot").drop("_hot").groupBy("m", "k").agg(*ends), "hot-runs")
    return few.unionByName(by_run(met_windows(one, window)))


def covered(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(_d, _h, starts array<int>): the windows of each row of `docs` that start in a document with a smaller doc_id too."""
    doc = lambda d: F.when(d == MISSING, _LAST).otherwise(d)
    data = docs.select(*row_key(), F.col("text").cast("binary").alias("data")).where("data IS NOT NULL")
    marks = data.select(doc(F.col("_d")).alias("doc"), "data").mapInArrow(lambda x: _minimisers(x, window, gram), "m long, doc long")
    shared = marks.groupBy("m").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("m")
    masks = docs.sparkSession.sparkContext.broadcast(filter_of(shared))
    schema = "m long, run binary, _d long, _h long, start int, n int"
    found = data.mapInArrow(lambda x: _packed(x, window, gram, masks.value), schema)
    found = stage(found.withColumn("k", F.xxhash64("run")), "super-k-mers").withColumn("doc", doc(F.col("_d")))
    early = stage(earliest(found, window, hot), "early")
    hits = likely_in(found.select("m", "k", "_d", "_h", "start"), "k", early.select("k")).join(early, ["m", "k"])
    starts = F.transform(F.filter("early", lambda e: e["least"] < doc(F.col("_d"))), lambda e: e["at"] + F.col("start"))
    hits = hits.select("_d", "_h", starts.alias("starts")).where(F.size("starts") > 0)
    return hits.groupBy("_d", "_h").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))


def _kept(words: list[bytes], starts: np.ndarray | None, window: int) -> list[bytes]:
    if starts is None or not len(starts):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    gone = np.cumsum(edges)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row of `docs`; `kept` is the text that is left, words joined by a blank.

    A word goes if a window of `window` words that covers it also starts in a
    row with a smaller doc_id. Windows are those of the input. Null texts have
    no words; a row without doc_id comes after all others, and such rows take
    nothing from each other, nor do rows of one doc_id. Rows equal in doc_id and
    text get equal results. A row's memory is in proportion to its text.
    """
    with scratch(docs.sparkSession):
        found = stage(covered(docs.select("doc_id", "text"), window, gram, hot), "covered", keep=True)
    d, h = row_key()
    data = docs.select("doc_id", F.col("text").cast("binary").alias("data"), d, h)
    data = flagged(data, "_h", found.select("_h"), "_hit")  # texts that lose nothing stay where they are
    rows = data.where("_hit").join(found, ["_d", "_h"], "left").select("doc_id", "data", "starts")
    rows = rows.unionByName(data.where("NOT _hit").select("doc_id", "data", F.lit(None).cast("array<int>").alias("starts")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_text = pc.CastOptions(pa.string(), allow_invalid_utf8=True)
        for batch in batches:
            n, left, digests, texts = [], [], [], []
            for i, data in enumerate(batch["data"].to_pylist()):
                words = (data or b"").split()
                starts = batch["starts"][i].values
                kept = _kept(words, None if starts is None else starts.to_numpy(), window)
                text = b" ".join(kept)
                n.append(len(words))
                left.append(len(words) - len(kept))
                digests.append(hashlib.sha256(text).hexdigest())
                texts.append(text)
            columns = [pa.array(n, pa.int64()), pa.array(left, pa.int64()), pa.array(digests, pa.string())]
            columns.append(pc.cast(pa.array(texts, pa.binary()), options=as_text))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def substring_sql(documents: str = "documents", window: int = WINDOW) -> str:
    """DuckDB: the same with every window as a string."""
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM {documents}),
each AS (SELECT r, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n, words FROM docs),
windows AS (SELECT r, i, coalesce(doc_id, {_LAST}) AS doc, array_to_string(words[i:i + {window - 1}], ' ') AS w FROM each WHERE i + {window - 1} <= n),
hits AS (SELECT r, i FROM windows JOIN (SELECT w, min(doc) AS least FROM windows GROUP BY w) USING (w) WHERE least < doc),
marked AS (SELECT e.r, e.i, e.word, max(CASE WHEN h.i IS NULL THEN 0 ELSE 1 END)
    OVER (PARTITION BY e.r ORDER BY e.i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone FROM each e LEFT JOIN hits h USING (r, i)),
kept AS (SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM marked GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""
