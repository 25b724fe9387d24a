"""Joins of requests with jobs, catalogs and block lists, and the alignment of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scans import unfolded

STRIPE, RUN_STRIPES, FEW_RUNS = 2097152, 1024, 16


def enrich_requests(requests: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with uid and nnode of their job, and those whose job isn't registered.

    Jobs are a small dimension; Spark broadcasts them while they are below its
    own threshold and shuffles both sides beyond it.
    """
    known = jobs.select("jobid", F.col("uid").alias("job_uid"), "nnode")
    return requests.join(known, "jobid"), requests.join(known, "jobid", "left_anti")


def user_group(connections: DataFrame, order: str = "conn_id") -> DataFrame:
    """(uid, gid), the first group seen of each user."""
    return connections.groupBy("uid").agg(F.min_by("gid", order).alias("gid"))


def add_group(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds gid, null for unknown users."""
    return df.join(groups, "uid", "left")


def align_slices(reports: DataFrame, group: list[str] = ()) -> DataFrame:
    """(group, time_in_seconds, tag, mbps) of runs (group, tag, end_s, slices, line).

    A run covers len(slices) seconds and ends in end_s. Seconds count from the
    first start, inclusive, to the last end, exclusive; a tag has 0 outside its
    run. Of a repeated tag the last line's slices count, but all its lines
    widen the range.
    """
    group = list(group)
    runs = reports.withColumn("start", F.col("end_s") - F.size("slices") + 1)
    span = runs.groupBy(*group).agg(F.min("start").alias("t0"), F.max("end_s").alias("t1"))
    last = runs.groupBy(*group, "tag").agg(F.max(F.struct("line", "start", "slices")).alias("_last")).select(*group, "tag", "_last.start", "_last.slices")
    every = last.join(span, group) if group else last.crossJoin(F.broadcast(span))
    every = unfolded(every, "t", F.col("t0"), F.col("t1") - 1)
    value = F.when((F.col("t") >= F.col("start")), F.get("slices", (F.col("t") - F.col("start")).cast("int")))
    return every.select(*group, (F.col("t") - F.col("t0")).cast("int").alias("time_in_seconds"), "tag", F.coalesce(value, F.lit(0.0)).alias("mbps"))


def check_creates(creates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds `status` to (path, parent, kind mkdir or open): EEXIST, OPENED, ENOENT or OK."""
    have = catalog.select("path", F.lit(True).alias("exists")).distinct()
    dirs = catalog.where("type = 4").select(F.col("path").alias("parent"), F.lit(True).alias("parent_exists")).distinct()
    rows = creates.join(have, "path", "left").join(dirs, "parent", "left")
    status = F.when(F.col("exists"), F.when(F.col("kind") == "mkdir", "EEXIST").otherwise("OPENED")).when(F.col("parent_exists").isNull(), "ENOENT").otherwise("OK")
    return rows.withColumn("status", status).drop("exists", "parent_exists")


def stat_paths(paths: DataFrame, catalog: DataFrame) -> DataFrame:
    """Metadata of each path; status ENOENT where there is none."""
    rows = paths.join(catalog.select("path", "type", "size"), "path", "left")
    return rows.withColumn("status", F.when(F.col("type").isNull(), "ENOENT").otherwise("OK"))


def locate_blocks(requests: DataFrame, extents: DataFrame, stripe: int = STRIPE, few: int = FEW_RUNS) -> DataFrame:
    """Adds the block (file_offset, block_size) that holds `off`, null if none does.

    An extent is one block, or, where it has a column `blocks`, a run of that
    many blocks of one size, which is joined as a whole. Blocks are put in one bucket for
    each stripe they touch, so the range condition runs within an equi-join on (path, bucket). Up to `few` runs of a
    path are joined by it alone. The runs of other paths are put in buckets of RUN_STRIPES stripes, or of the path's mean run
    if that is longer, so that they have at most three rows each in the mean, however long they are. Both sides are as
    large as the file system, so neither is ever broadcast.
    """
    runs = "blocks" in extents.columns
    ends = F.col("file_offset") + F.col("block_size") * (F.col("blocks") if runs else F.lit(1))
    parts = extents.where("block_size > 0").select(F.col("path").alias("_p"), F.col("file_offset").alias("_start"), ends.alias("_end"), "block_size").where("_start < _end")
    within = (F.col("off") >= F.col("_start")) & (F.col("off") < F.col("_end"))
    names = [*requests.columns, F.expr("_start + (off - _start) div block_size * block_size").alias("file_offset"), "block_size"]

    def bucketed(rows: DataFrame, parts: DataFrame) -> DataFrame:
        """`rows` and `parts` with the widths of their paths, joined within buckets."""
        parts = parts.withColumn("_b", F.explode(F.sequence(F.expr("_start div _width"), F.expr("(_end - 1) div _width")))).drop("_width")
        rows = rows.withColumn("_bucket", F.expr("off div _width")).drop("_width")
        return rows.join(parts.hint("merge"), (F.col("path") == F.col("_p")) & (F.col("_bucket") == F.col("_b")) & within, "left").select(*names)

    if not runs:
        one = F.lit(stripe).cast("long")
        return bucketed(requests.withColumn("_width", one), parts.withColumn("_width", one))
    mean = F.ceil(F.sum((F.col("_end") - F.col("_start")).cast("double")) / F.count("*"))
    widths = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.greatest(mean, F.lit(stripe * RUN_STRIPES)).alias("_width"))
    widths = widths.where(F.col("_n") > few).drop("_n")
    parts = parts.join(widths.hint("merge"), "_p", "left")
    none = lambda c: F.lit(None).cast("long").alias(c)
    # A path of many runs has its width in place of them.
    first = parts.where("_width IS NULL").select("_p", "_start", "_end", "block_size", "_width")
    first = first.unionByName(widths.select("_p", none("_start"), none("_end"), none("block_size"), "_width"))
    found = requests.join(first.hint("merge"), (F.col("path") == F.col("_p")) & (F.col("_width").isNotNull() | within), "left")
    many = bucketed(found.where("_width IS NOT NULL").select(*requests.columns, "_width"), parts.where("_width IS NOT NULL"))
    return found.where("_width IS NULL").select(*names).unionByName(many)


def verify_readback(words: DataFrame, iosize: int) -> DataFrame:
    """Per path and I/O unit of words (path, off, value): the first offset whose word isn't the offset, and `passed`."""
    bad = F.min(F.when(F.col("value") != F.col("off"), F.col("off")))
    return words.groupBy("path", F.expr(f"off div {iosize}").alias("unit")).agg(bad.alias("first_bad")).withColumn("passed", F.col("first_bad").isNull())


def check_removes(removes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds `status` to (path, kind rmdir or unlink): ENOENT, ENOTEMPTY or OK."""
    have = catalog.select("path", "type").distinct()
    full = catalog.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("entries"))
    rows = removes.join(have, "path", "left").join(full, "path", "left")
    missing = F.when(F.col("kind") == "rmdir", F.coalesce(F.col("type") != 4, F.lit(True))).otherwise(F.coalesce(F.col("type") != 8, F.lit(True)))
    status = F.when(missing, "ENOENT").when((F.col("kind") == "rmdir") & (F.coalesce("entries", F.lit(0)) > 0), "ENOTEMPTY").otherwise("OK")
    return rows.withColumn("status", status).drop("type", "entries")


def first_rows(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
