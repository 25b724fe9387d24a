"""What the operators share: staging, a bounded membership filter and distributed union-find.

Row identity: `documents` may repeat a doc_id or hold a null one, so an operator
that must find its rows again keys them by (`coalesce(doc_id, MISSING)`,
`xxhash64(text)`); rows equal in both are copies of one row and share its fate.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs.shared import shared_dir

MISSING = -(2**63)
#: Words are runs of anything but these; bytes.split() cuts at exactly the same set.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A membership filter has this many 64-bit words: 8 Mbit, 1 MB of masks, whatever the input.
FILTER_WORDS = 1 << 17
#: Members of an array that are added up together.
CHUNK = 128


#: Paths of the tables that go at the end of each `scratch` that has begun, the innermost last.
_WRITTEN: list[list[str]] = []


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes the shuffle files of a write or action as soon as it has ended; else they stay until the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """`df` written to the shared folder as Parquet and read again: cuts the lineage, survives lost executors. It goes at the end of the `scratch` around it, or, if it is to `keep`, of the one around that."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with tidied(spark):
        df.write.parquet(path)
    if len(_WRITTEN) > keep:
        _WRITTEN[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that `stage` wrote within it; those to be kept go with the `scratch` around this one, if there is any."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for path in _WRITTEN.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """The two columns `_d`, `_h` that name a row of documents."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(MISSING)).alias("_d"), F.xxhash64(F.col(text)).alias("_h")]


def flagged(df: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """`df` with a boolean `name`: whether its long `key` may be in the one-column `keys`. No member is told no, some others yes.

    A one-hash Bloom filter of FILTER_WORDS words is joined by broadcast, so its
    size has a bound. It only spares work on rows that what follows would drop;
    where there are more keys than bits it says yes to all.
    """
    word = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_WORDS))
    bit = lambda c: F.shiftright(F.xxhash64(c), 40).bitwiseAND(63).cast("int")
    k = F.col(keys.columns[0])
    masks = keys.select(word(k).alias("_word"), F.expr("1L").alias("_one"), bit(k).alias("_bit"))
    masks = masks.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(_one, _bit)")).alias("_mask"))
    out = df.withColumns({"_word": word(F.col(key)), "_bit": bit(F.col(key))}).join(F.broadcast(masks), "_word", "left")
    return out.select(*df.columns, F.coalesce(F.expr("getbit(_mask, _bit) = 1"), F.lit(False)).alias(name))


def likely_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of `df` whose long `key` may be in the one-column `keys` (see `flagged`), to spare the others the shuffle of an exact join."""
    return flagged(df, key, keys, "_likely").where("_likely").select(*df.columns)


def _totals(sizes: Column) -> Column:
    """The running totals of an array of longs. It grows an array by copying, so it is for short ones."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("upto"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["upto"], F.array(acc["sum"] + x)).alias("upto"))

    return F.aggregate(sizes, start, step)["upto"]


def running_totals(sizes: Column) -> Column:
    """The running totals of an array of longs of any length: within chunks of CHUNK, then over the chunks."""
    first = F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(CHUNK))
    bound = lambda x, use: F.get(F.transform(F.array(x), use), F.lit(0))  # noqa: E731  made once, however often it is used

    def joined(chunks: Column) -> Column:
        before = _totals(F.transform(chunks, lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(0).cast("long"))))
        shifted = F.zip_with(chunks, before, lambda c, upto: F.transform(c, lambda x: x + upto - F.try_element_at(c, F.lit(-1))))
        return F.flatten(shifted)

    return bound(F.transform(first, lambda i: _totals(F.slice(sizes, i, CHUNK))), joined)


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find: (node, comp) for each node of the long pairs `a`, `b`; comp is the smallest node reachable.

    Each round hooks every node onto its smallest neighbour and relabels the
    edges by it, until none is left. Nodes are renamed by xxhash64, which maps
    8-byte values one to one, so that chains of sorted ids don't make rounds
    many. Minima are combined before the shuffle and joins on a hub are split
    by the skew join; only edge counts reach the driver. Null ends and loops
    join nothing; no edges, no rows.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    with tidied(spark):
        names = edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"), F.col("a").alias("x"), F.col("b").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
        known = names.select(F.col("a").alias("v"), F.col("x").alias("node")).union(names.select("b", "y")).distinct()
        live = names.select("a", "b").where("a <> b").distinct().checkpoint()
        hooks = []
        while not live.isEmpty():
            ends = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
            up = ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p"))
            jump = up.alias("u").join(up.select(F.col("v").alias("w"), F.col("p").alias("q")), F.col("p") == F.col("w"), "left")
            up = jump.select("v", F.least("p", F.coalesce("q", "p")).alias("p")).checkpoint()
            hooks.append(up)
            moved = live.join(up.select(F.col("v").alias("a"), F.col("p").alias("a2")), "a").join(up.select(F.col("v").alias("b"), F.col("p").alias("b2")), "b")
            live = moved.where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct().checkpoint()
        root = known.withColumn("r", F.col("v"))
        for up in hooks:
            root = root.join(up.select(F.col("v").alias("r"), "p"), "r", "left").select("v", "node", F.coalesce("p", "r").alias("r"))
        root = root.checkpoint()
    least = root.groupBy("r").agg(F.min("node").alias("comp"))
    return root.join(least, "r").select("node", "comp")


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, comp) after more `links` (a, b): only the components that these touch are united anew."""
    for k in "ab":
        links = links.join(comps.select(F.col("node").alias(k), F.col("comp").alias(f"comp_{k}")), k, "left")
    over = components(links.select(*[F.coalesce(f"comp_{k}", k).alias(k) for k in "ab"]))
    over = stage(over.select(F.col("node").alias("comp"), F.col("comp").alias("least")), "joined")
    old = comps.join(over, "comp", "left").select("node", F.coalesce("least", "comp").alias("comp"))
    new = over.join(comps.select(F.col("node").alias("comp")), "comp", "left_anti")
    return old.unionByName(new.select(F.col("comp").alias("node"), F.col("least").alias("comp")))


def pairs_of_lists(marked: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nodes of each key of `marked` (key, node, comp) that lie in different components."""
    x, y = (marked.select("key", F.col("node").alias(n), F.col("comp").alias(f"c{n}")) for n in "ab")
    return x.join(y, "key").where("a < b AND ca <> cb").select("a", "b")


def linked_classes(
    posts: DataFrame, verify: Callable[[DataFrame], DataFrame], stars: int = 2, rest: Callable[[DataFrame], DataFrame] | None = None, known: DataFrame | None = None
) -> DataFrame:
    """Components (node, comp) of the nodes that `verify` links among those that meet under a key of `posts` (key, node, and perhaps score).

    Not all pairs under a key are formed. In each of `stars` rounds every node
    is held against one pivot of its key (the node with the highest score, then
    one drawn by hash from the key's largest component) unless the two are known
    to be in one component. What is left then is each
    pair of nodes of a key that lie in different components and of which
    neither was a pivot; `rest` finds enough links (a, b) among those pairs that no
    two linked components stay apart (if not given, it forms the pairs and verifies
    them). `known` links (a, b) hold from the start. A group of near
    copies closes in the first rounds and leaves no pairs. A star round may have
    no new pair because it drew a pivot again; the work ends before `rest` only if no key is open.
    """
    posts = posts if "score" in posts.columns else posts.withColumn("score", F.lit(0))
    posts = stage(posts.select("key", "node", "score").distinct(), "posts")
    rest = rest or (lambda marked: verify(stage(pairs_of_lists(marked).distinct(), "pairs")))
    comps, held = None, None
    for turn in range(stars + 1):
        if comps is None:
            marked = posts.withColumn("comp", F.col("node"))
        else:
            marked = posts.join(comps, "node", "left").select("key", "node", "score", F.coalesce("comp", "node").alias("comp"))
            open_keys = marked.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
            marked = marked.join(open_keys, "key")
        if turn < stars:
            if turn == 0:
                pivots = marked.groupBy("key").agg(F.max(F.struct("score", "node", "comp")).alias("p"))
            else:
                parts = marked.groupBy("key", "comp").agg(F.count("*").alias("size"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("node"))
                pivots = parts.groupBy("key").agg(F.max(F.struct("size", "node", "comp")).alias("p"))
            pivots = pivots.select("key", F.col("p.node").alias("pn"), F.col("p.comp").alias("pc"))
            pairs = marked.join(pivots, "key").where("comp <> pc").select(F.least("node", "pn").alias("a"), F.greatest("node", "pn").alias("b")).distinct()
            if held is not None:
                pairs = pairs.join(held, ["a", "b"], "left_anti")
            pairs = stage(pairs, "pairs")
            if pairs.isEmpty():
                continue
            held = pairs if held is None else held.unionByName(pairs)
            found = verify(pairs)
        else:
            open_ = stage(marked.select("key", "node", "comp"), "open")
            if open_.isEmpty():
                break
            found = rest(open_)
        found = stage(found.select("a", "b"), "links")
        if comps is None:
            first = found if known is None else found.unionByName(known.select("a", "b"))
            if not first.isEmpty():
                comps = stage(components(first), "comps")
        elif not found.isEmpty():
            comps = stage(joined(comps, found), "comps")
    if comps is None and known is not None and not known.isEmpty():
        comps = stage(components(known), "comps")
    if comps is None:
        comps = stage(posts.select("node", F.col("node").alias("comp")).limit(0), "comps")
    return comps


def ship(module_name: str) -> None:
    """Sends the functions of a module to tasks by value, so that executors needn't have this package installed."""
    register_pickle_by_value(sys.modules[module_name])
