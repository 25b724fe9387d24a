"""Near-duplicate documents by a signature-coordinate inverted join.

A document's set holds the 64-bit hashes of its distinct 5-word shingles.
Documents with equal sets form a class at once; a class is posted under each
(coordinate, value) pair of its MinHash signature of COORDINATES values. Two
sets of similarity 0.75 agree in 36 of 48 coordinates on average, with a
standard deviation of 3; a pair must agree in MATCHES = 26, which misses 0.03 %
of pairs at 0.75 and fewer above.

Prefix merging: of the coordinates in order of their posting list's length, two
classes with MATCHES agreements share one of the first
COORDINATES - MATCHES + 1. Values that no other class has come first in that
order and need no list, so a class with too many of them is skipped outright,
and the longest lists, such as those of a passage in a third of all documents,
are skipped by all that have enough shorter ones. Agreements of the pairs that
meet are counted on the signatures; links are confirmed on the full sets.
Lists that stars leave open are merged by their full sets. In those of more than
SHORT classes, those of up to BLOCK classes and BLOCK_SHINGLES shingles are compared
whole in one small task; in longer ones members are split by set size (a link needs sizes within 3:4) and
hash into blocks of about that size, and each pair of
blocks is a task, which counts the common shingles of all its
pairs at once and returns a spanning forest of the links it finds, so that no
list, however long, gives more rows than it has members in its blocks. Shorter
lists give their pairs to the same exact test.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flagged, likely_in, linked_classes, pairs_of_lists, row_key, scratch, ship, stage

ship(__name__)

WORDS, THRESHOLD, COORDINATES, MATCHES, SEED = 5, 0.75, 48, 26, 20
_rng = np.random.default_rng(SEED)
_A = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_CACHE_WORDS, _SLICE = 200_000, 4096
SHORT, BLOCK, BLOCK_SHINGLES, COLUMNS = 64, 2048, 1 << 20, 2048


class _Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_set(data: bytes, known: _Words, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; fewer words than a shingle make one, none make an empty set."""
    tokens = data.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    size = min(words, len(tokens))
    each = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    h = np.full(len(tokens) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ each[i : i + len(h)]) * _MUL
        h ^= h >> np.uint64(29)
    h *= _MIX
    return np.unique(h ^ (h >> np.uint64(32)))


def signature(members: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for at in range(0, len(members), _SLICE):  # bounded memory for very long texts
        least = np.minimum(least, (members[at : at + _SLICE, None] * _A + _B).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch in batches:
        n, c1, c2, sigs = [], [], [], []
        for data in batch["data"].to_pylist():
            members = shingle_set(data or b"", known)
            n.append(len(members))
            key = np.frombuffer(hashlib.blake2b(members.tobytes(), digest_size=16).digest(), np.int64) if len(members) else (None, None)
            c1.append(key[0])
            c2.append(key[1])
            sigs.append(signature(members) if len(members) else None)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "c1", "c2", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch in batches:
        members = [shingle_set(data or b"", known) for data in batch["data"].to_pylist()]
        keys = [np.frombuffer(hashlib.blake2b(m.tobytes(), digest_size=16).digest(), np.int64) for m in members]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([m.view(np.int64) for m in members], pa.list_(pa.int64()))], ["node", "c1", "c2", "members"])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of `sets` have in common: frequent shingles by matrix products, rare ones pair by pair."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.zeros(n * n, np.int32)
    order = np.lexsort((owner, column))
    owner, column = owner[order], column[order]
    often = df > max(2, n // 64)
    for k in np.unique(df[(df > 1) & ~often]):  # shingles of k owners each
        of, (i, j) = owner[(df == k)[column]].reshape(-1, k), np.tril_indices(k, -1)
        common += np.bincount((of[:, i] * n + of[:, j]).ravel(), minlength=n * n).astype(np.int32)
    common = common.reshape(n, n)
    common += common.T
    place = np.cumsum(often) - 1
    at, row = place[column[often[column]]], owner[often[column]]
    for lo in range(0, int(often.sum()), COLUMNS):
        here = (at >= lo) & (at < lo + COLUMNS)
        x = np.zeros((n, COLUMNS), np.float32)
        x[row[here], at[here] - lo] = 1
        common += (x @ x.T).astype(np.int32)
    return common


def _linked(group: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links across the two sides of a block pair, or within a block that is paired with itself (side 0)."""
    group = group.sort_values("node", kind="stable")
    sets = [np.asarray(x) for x in group["members"]]
    node, comp, side = (group[c].to_numpy() for c in ("node", "comp", "side"))
    common, size = common_counts(sets), np.array([len(x) for x in sets], np.int32)
    near = (100 + round(100 * THRESHOLD)) * common >= round(100 * THRESHOLD) * (size[:, None] + size[None, :])
    near &= (comp[:, None] != comp[None, :]) & ((side[:, None] != side[None, :]) | (side[:, None] == 0))
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        a, b = root(int(comp[i])), root(int(comp[j]))
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((node[i], node[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _merge_long_lists(marked: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of each list of `marked` (key, node, comp) as all its links do; `sets` has node and members."""
    asked = sets.join(marked.select("node").distinct(), "node").select("node", "members", F.size("members").alias("n"))
    rows = marked.join(asked.select("node", "n", F.floor(F.log("n") / float(np.log(4 / 3)) + 1e-9).alias("band")), "node")
    whole = rows.groupBy("key").agg(((F.count("*") <= BLOCK) & (F.sum("n") <= BLOCK_SHINGLES)).alias("whole"))
    rows = stage(rows.join(whole, "key").withColumn("band", F.when(F.col("whole"), -1).otherwise(F.col("band"))).drop("whole"), "banded")
    bands = rows.groupBy("key", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    rows = rows.join(bands, ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    above = bands.select("key", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = bands.select("key", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    rows = rows.join(above, ["key", "band"], "left").join(below, ["key", "band"], "left")
    to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pair = lambda lo, x, hi, y, side: F.struct(lo.alias("lo"), x.alias("x"), hi.alias("hi"), y.alias("y"), side.cast("int").alias("side"))
    band, block = F.col("band"), F.col("block")
    own = F.transform(to(F.col("blocks")), lambda o: pair(band, F.least(block, o), band, F.greatest(block, o), F.when(block < o, 1).when(block > o, 2).otherwise(0)))
    up = F.when(F.col("above").isNotNull(), F.transform(to(F.col("above")), lambda o: pair(band, block, band + 1, o, F.lit(1))))
    down = F.when(F.col("below").isNotNull(), F.transform(to(F.col("below")), lambda o: pair(band - 1, o, band, block, F.lit(2))))
    none = F.filter(own, lambda x: F.lit(False))
    dealt = rows.select("key", "node", "comp", F.explode(F.concat(own, F.coalesce(up, none), F.coalesce(down, none))).alias("p"))
    held = dealt.select("node", "comp", "key", "p.*").join(asked.select("node", "members"), "node")
    return held.groupBy("key", "lo", "x", "hi", "y").applyInPandas(_linked, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs`.

    Rows without words, null texts included, have n_shingles 0 and are linked
    with nothing. Rows of one doc_id are one document: they are in one
    component, even with different texts. A row without doc_id joins no
    component (component_id null, kept true).
    """
    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    rows = stage(data.mapInArrow(_signed, "doc_id long, n_shingles long, c1 long, c2 long, sig array<int>"), "signatures")
    named = rows.where("c1 IS NOT NULL AND doc_id IS NOT NULL")
    classes = stage(named.groupBy("c1", "c2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")
    reps = named.select(F.col("doc_id").alias("node"), "c1", "c2", "sig").join(classes.select("node", "c1", "c2"), ["node", "c1", "c2"]).dropDuplicates(["node", "c1", "c2"])
    reps = stage(reps, "reps")

    posts = reps.select("node", F.posexplode("sig").alias("coordinate", "value")).select(F.xxhash64("coordinate", "value").alias("key"), "node")
    lists = stage(posts.groupBy("key").agg(F.count("*").alias("length")).where("length > 1"), "lists")
    posts = likely_in(posts, "key", lists.select("key")).join(lists, "key")
    ranked = posts.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("length", "key"))).alias("ranked")).where(F.size("ranked") >= MATCHES)
    prefix = ranked.select("node", F.explode(F.slice("ranked", F.lit(1), F.size("ranked") - (MATCHES - 1))).alias("post")).select("post.key", "node")
    prefix = stage(prefix, "prefix")

    asked = stage(prefix.select("node").distinct(), "asked")
    texts = likely_in(data.withColumnRenamed("doc_id", "node").where("node IS NOT NULL AND data IS NOT NULL"), "node", asked).join(asked, "node")
    sets = texts.mapInArrow(_sets, "node long, c1 long, c2 long, members array<long>").join(reps, ["node", "c1", "c2"]).dropDuplicates(["node", "c1", "c2"]).select("node", "members", "sig")
    sets = stage(sets, "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        sides = [sets.select(F.col("node").alias(k), F.col("sig").alias(f"sig_{k}")) for k in "ab"]
        both = pairs.join(sides[0], "a").join(sides[1], "b")
        agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        near = stage(both.where(agree >= MATCHES).select("a", "b"), "near")
        sides = [sets.select(F.col("node").alias(k), F.col("members").alias(f"set_{k}")) for k in "ab"]
        both = near.join(sides[0], "a").join(sides[1], "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
        return both.where(100 * F.col("common") >= round(100 * THRESHOLD) * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b")

    def rest(marked: DataFrame) -> DataFrame:
        sizes = stage(marked.groupBy("key").agg(F.count("*").alias("length")), "lengths")
        marked = marked.join(sizes, "key")
        short = stage(pairs_of_lists(marked.where(F.col("length") <= SHORT)).distinct(), "short")
        return verify(short).unionByName(_merge_long_lists(marked.where(F.col("length") > SHORT).drop("length"), sets))

    # A doc_id with several texts joins their classes.
    several = named.groupBy("doc_id").agg(F.min("c1").alias("lo1"), F.max("c1").alias("hi1"), F.min("c2").alias("lo2"), F.max("c2").alias("hi2")).where("lo1 < hi1 OR lo2 < hi2").select("doc_id")
    held = stage(named.join(several, "doc_id").join(classes, ["c1", "c2"]).select("doc_id", "node").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")), "same-id")
    comps = linked_classes(prefix, verify, rest=rest, known=held)
    joined = classes.join(comps, "node", "left").where("copies > 1 OR comp IS NOT NULL").select("c1", "c2", F.coalesce("comp", "node").alias("comp"))
    out = rows.select("doc_id", "n_shingles", "c1", "c2").join(joined, ["c1", "c2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component, of the smallest doc_id.

    Of several rows with that doc_id, equal or not, one stays: the one with the
    smallest hashes of its text and of all its columns. Rows without doc_id are
    in no component; of those with equal texts one stays. Null and empty texts
    are linked with nothing, so that only such repeated rows go.
    """
    with scratch(docs.sparkSession):
        gone = stage(near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone", keep=True)
    left = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*docs.columns)
    d, h = row_key()
    key = F.xxhash64(d, F.when(F.col("doc_id").isNull(), h))
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    again = left.select(key.alias("_key")).groupBy("_key").agg(F.count("*").alias("_rows")).where("_rows > 1").select("_key")
    rows = flagged(left.select(own.alias("_row"), key.alias("_key"), h), "_key", again, "_again")
    first = rows.where("_again").groupBy("_key").agg(F.min_by("_row", F.struct("_h", F.xxhash64(F.to_json("_row")))).alias("_row"))
    both = rows.where("NOT _again").select("_row").unionByName(first.select("_row"))
    return both.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
