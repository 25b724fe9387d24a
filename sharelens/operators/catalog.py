"""File catalogs from event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import split_path
from ..jobs.shared import saved, shared_dir
from .scans import offsets, ranges

PAGE_LIMIT = 1 << 20
#: Events of a directory's entries that one task looks at.
SALTED = 1 << 16


def catalog_snapshot(events: DataFrame, as_of: int | None = None) -> DataFrame:
    """(path, type, size, parent, entry) that survives a log of successful events.

    Events are (event_id, t, kind, path, new_path, max_range), kind mkdir,
    create, close, unlink, rmdir or rename (of a file). A rename removes the
    source and makes the destination with the size that the source's current
    life had, its earlier names included. Ties in time go by event_id.
    """
    log = events if as_of is None else events.where(F.col("t") <= as_of)
    moves = log.where("kind = 'rename' AND path <> new_path")
    steps = log.where("kind <> 'rename'").select("path", "t", "event_id", "kind", "max_range")
    gone = moves.select("path", "t", "event_id", F.lit("unlink").alias("kind"), F.lit(None).cast("long").alias("max_range"))
    made = moves.join(_moved_sizes(steps, moves), "event_id", "left").select(F.col("new_path").alias("path"), "t", "event_id", F.lit("create").alias("kind"), F.col("own").alias("max_range"))
    steps = steps.unionByName(gone).unionByName(made)
    order = Window.partitionBy("path").orderBy("t", "event_id")
    born = F.when(F.col("kind").isin("mkdir", "create", "unlink", "rmdir"), F.struct("t", "event_id", "kind"))
    last = steps.withColumn("last", F.last(born, True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    alive = last.where(F.col("last.kind").isin("mkdir", "create") & (F.struct("t", "event_id") >= F.struct("last.t", "last.event_id")))
    out = alive.groupBy("path").agg(F.first("last.kind").alias("k"), F.coalesce(F.max("max_range"), F.lit(0)).cast("long").alias("size"))
    parts = split_path(F.col("path"))
    return out.select("path", F.when(F.col("k") == "mkdir", 4).otherwise(8).alias("type"), "size", parts["parent"].alias("parent"), parts["entry"].alias("entry"))


def _moved_sizes(steps: DataFrame, moves: DataFrame) -> DataFrame:
    """(event_id, own): the size a file has when the rename `event_id` takes it, from closes under all its names.

    The current life of the source begins at its last event that makes or ends a
    file. If that is a rename too, the size it brought counts as well; `up` points to it, and
    pointers are doubled until none is left.
    """
    if moves.isEmpty():
        return moves.select("event_id", F.col("max_range").cast("long").alias("own"))
    shared_dir(moves.sparkSession)
    none = F.lit(None).cast("long")
    out, into = (moves.select(F.col(path).alias("path"), "t", "event_id", F.lit(kind).alias("kind"), none.alias("max_range")) for path, kind in (("path", "out"), ("new_path", "in")))
    turns = F.col("kind").isin("mkdir", "create", "unlink", "rmdir", "in", "out")
    order = Window.partitionBy("path").orderBy("t", "event_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.unionByName(out).unionByName(into).withColumn("life", F.count(F.when(turns, 1)).over(upto) - (F.col("kind") == "out").cast("int"))
    lives = Window.partitionBy("path", "life")
    begun = F.when(F.col("kind") == "in", F.col("event_id"))
    rows = rows.withColumns({"own": F.max("max_range").over(lives), "up": F.max(begun).over(lives)})
    found = rows.where("kind = 'out'").select("event_id", "own", "up").checkpoint()
    while not found.where("up IS NOT NULL").isEmpty():
        above = found.select(F.col("event_id").alias("up"), F.col("own").alias("brought"), F.col("up").alias("next"))
        found = found.join(above, "up", "left").select("event_id", F.greatest("own", "brought").alias("own"), F.col("next").alias("up")).checkpoint()
    return found.select("event_id", "own")


def replay_status(events: DataFrame, root: str = "/myfs", salted: int = SALTED) -> DataFrame:
    """Adds `status` to mkdir, create, unlink and rmdir events (event_id, t, kind, path) replayed in order of (t, event_id).

    A path that exists can't be made again (EEXIST, for create OPENED), nor one
    below a directory that doesn't exist (ENOENT); unlink removes files and rmdir directories
    only (ENOENT), the latter once they are empty (ENOTEMPTY). `root` and paths
    directly below "/" need no directory. An event without path or kind has status null.

    Whether an event succeeds follows from what succeeded before it on its own
    path, on its directory and, for rmdir, on the entries of its path. So all
    events are guessed to succeed, and in rounds each is judged by the guesses about earlier
    ones, looked up as of its time, until a round changes nothing. After round k all
    events are right whose wrong guesses hang together in chains of fewer than k, and the
    earliest wrong one always is: a log whose events mostly succeed takes few rounds, whatever its length or depth.

    An event lies beside its directory's own events, in the order of time. A
    directory with more than `salted` events has its entries dealt over several
    tasks, each with a copy of the directory's events, and rmdir adds up what they count.
    """
    known = F.col("kind").isin("mkdir", "create", "unlink", "rmdir") & F.col("path").isNotNull()
    folder = F.regexp_replace("path", "/[^/]*$", "")
    log = events.select("event_id", "t", "kind", "path", known.alias("known"), folder.alias("dir"))
    log = saved(log.withColumn("row", F.monotonically_increasing_id()))
    own = log.where("known").select("row", "t", "event_id", "kind", "path", "dir")
    salts = own.groupBy("dir").agg(F.ceil(F.count("*") / salted).cast("int").alias("salts")).where("salts > 1")
    own = own.join(salts, "dir", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = own.withColumn("salt", F.pmod(F.xxhash64("path"), F.col("salts")).cast("int")).drop("salts")
    salts = salts.select(F.col("dir").alias("path"), "salts")
    above = own.where("kind IN ('mkdir', 'rmdir')").join(salts, "path", "left")
    above = above.withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    entry = own.select("dir", "salt", "path", "t", "event_id", "row", "kind", F.lit(True).alias("entry"))
    above = above.select(F.col("path").alias("dir"), F.col("copy").alias("salt"), "path", "t", "event_id", "row", "kind", F.lit(False).alias("entry"))
    both = saved(entry.unionByName(above))  # an event of a directory has as many rows as its entries have tasks, and one more

    order = ["t", "event_id", "row"]
    before = Window.partitionBy("dir", "salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    of_path = Window.partitionBy("dir", "salt", "entry", "path").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    made, ok = F.col("kind").isin("mkdir", "create"), ~F.col("failed")
    free = F.col("dir").isin("", root)

    def judged(rows: DataFrame) -> DataFrame:
        """(row, status, old) by the guesses `failed` about earlier events; `old` is what the guess was made from."""
        rows = rows.withColumns(
            {
                "there": F.last(F.when(~F.col("entry") & ok, F.col("kind")), True).over(before) == "mkdir",
                "entries": F.sum(F.when(F.col("entry") & ok, F.when(made, 1).otherwise(-1))).over(before),
                "was": F.last(F.when(ok, F.col("kind")), True).over(of_path),
            }
        )
        full = rows.where("NOT entry AND kind = 'rmdir'").groupBy("row").agg((F.sum("entries") > 0).alias("full")).where("full")
        rows = rows.where("entry").join(full, "row", "left")
        was = F.coalesce("was", F.lit(""))
        making = F.when(was.isin("mkdir", "create"), F.when(F.col("kind") == "mkdir", "EEXIST").otherwise("OPENED"))
        making = making.when(~free & ~F.coalesce("there", F.lit(False)), "ENOENT").otherwise("OK")
        wrong = was != F.when(F.col("kind") == "rmdir", "mkdir").otherwise("create")
        status = F.when(made, making).when(wrong, "ENOENT").when(F.col("full"), "ENOTEMPTY").otherwise("OK")
        return rows.select("row", status.alias("status"), "old")

    found = saved(judged(both.withColumns({"failed": F.lit(False), "old": F.lit("OK")})))
    while not found.where("status <> old").isEmpty():
        failed = found.where("status <> 'OK'").select("row", F.col("status").alias("old"))
        rows = both.join(failed, "row", "left").withColumns({"failed": F.col("old").isNotNull(), "old": F.coalesce("old", F.lit("OK"))})
        found = saved(judged(rows))
    return log.join(found, "row", "left").select("event_id", "t", "kind", "path", "status")


def list_directory(catalog: DataFrame, parent: str, offset: int = 0, limit: int = PAGE_LIMIT, dots: bool = False) -> DataFrame:
    """(at, entry, type, total, status): a page of a directory's entries by name; one ENOENT row if there is no such directory.

    Names are put in ranges; those that the page lies in are found by their
    numbers of names and are the only ones that are put in order. `total` counts all names.
    """
    spark, limit = catalog.sparkSession, max(0, min(limit, PAGE_LIMIT))
    here = catalog.where((F.col("path") == parent) & (F.col("type") == 4)).select(F.lit(True).alias("found")).limit(1)
    names = catalog.where(F.col("parent") == parent).select("entry", "type")
    if dots:
        for dot in (".", ".."):
            names = names.unionByName(spark.range(1).select(F.lit(dot).alias("entry"), F.lit(4).alias("type")))
    parts = ranges(names, [], ["entry"])
    found = offsets(parts, [], n=F.lit(1))
    total = found.agg(F.coalesce(F.max("n_all"), F.lit(0)).alias("total"))
    inside = found.where((F.col("n_before") < offset + limit) & (F.col("n_before") + F.col("n") > offset))
    rows = parts.join(inside.select("_part", "n_before"), "_part")
    at = F.col("n_before") + F.row_number().over(Window.partitionBy("_part").orderBy("entry", "type")) - 1
    page = rows.withColumn("at", at.cast("long")).where((F.col("at") >= offset) & (F.col("at") < offset + limit))
    page = page.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(here.select(F.lit("OK").alias("status"))))
    none = spark.range(1).crossJoin(F.broadcast(here.agg(F.count("*").alias("n")))).where("n = 0")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    missing = none.select(null("long", "at"), null("string", "entry"), null("int", "type"), F.lit(0).cast("long").alias("total"), F.lit("ENOENT").alias("status"))
    return page.select("at", "entry", "type", "total", "status").unionByName(missing)
