"""Throughput, counts, statistics and directory totals. Sums are combined before each shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import exact_percentiles, unfolded

MIB = 1048576
# Inodes and pages of a server, the longest name.
INODES, PAGES, NAME_LENGTH = 1 << 24, 4 * 8192 * 1024, 164


def throughput_slices(events: DataFrame, key: str, width_s: int = 1) -> DataFrame:
    """A1: (key, slice, mbps) from (key, t seconds, nlen), counted from the key's first event, with 0 for empty slices."""
    firsts = events.groupBy(key).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    sums = events.join(firsts, key).groupBy(key, F.expr(f"(t - t0) div {width_s}").alias("slice")).agg(F.sum("nlen").alias("bytes"))
    # A key's slices are unfolded in chunks that are dealt out, as a key may span years.
    every = unfolded(firsts.select(key, F.expr(f"(t1 - t0) div {width_s}").alias("last")), "slice", F.lit(0), F.col("last"), deal=True)
    return every.join(sums, [key, "slice"], "left").select(key, "slice", (F.coalesce("bytes", F.lit(0)) / MIB / width_s).alias("mbps"))


def run_summary(rank_bytes: DataFrame, elapsed_s: float) -> DataFrame:
    """A2: (jobid, mbps, rank_stddev) from (jobid, rank, bytes); the deviation of one rank alone is NaN."""
    rate = F.col("bytes") / (MIB * elapsed_s)
    ranks = rank_bytes.groupBy("jobid", "rank").agg(F.sum("bytes").alias("bytes"))
    return ranks.groupBy("jobid").agg((F.sum("bytes") / (MIB * elapsed_s)).alias("mbps"), F.coalesce(F.stddev_samp(rate), F.lit(float("nan"))).alias("rank_stddev"))


def ops_done(requests: DataFrame, by: list[str]) -> DataFrame:
    """A3"""
    return requests.groupBy(*by).agg(F.count("*").alias("ops"))


def merge_server_counts(counts: DataFrame) -> DataFrame:
    """A4: (jobid, ops, nnode, total_ops, total_nodes) from (server, jobid, nnode, ops); nnode is the first server's."""
    jobs = counts.groupBy("jobid").agg(F.sum("ops").alias("ops"), F.min_by("nnode", "server").alias("nnode"))
    totals = jobs.agg(F.sum("ops").alias("total_ops"), F.sum("nnode").alias("total_nodes"))
    return jobs.crossJoin(F.broadcast(totals))


def set_name(candidates: Column | str) -> Column:
    """A short name of a candidate set: equal for sets of the same ids, in whatever order and number."""
    return F.unhex(F.md5(F.array_join(F.array_sort(F.array_distinct(candidates)), ",")))


def with_zeros(members: Column | str, chosen: Column | str) -> Column:
    """array<(id, n)> of the sorted `members`: n from the (id, n) in `chosen`, which are distinct ids, 0 where it isn't there."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    mine = F.transform(members, lambda x: F.struct(x.alias("id"), zero.alias("side"), zero.alias("n")))
    both = F.array_sort(F.concat(mine, F.transform(chosen, lambda r: F.struct(r["id"].alias("id"), one.alias("side"), r["n"].alias("n")))))
    # A member's choices follow it directly.
    count = lambda rows: lambda r, i: F.struct(r["id"].alias("id"), r["side"].alias("side"), F.when(F.get(rows, i + 1)["id"] == r["id"], F.get(rows, i + 1)["n"]).otherwise(zero).alias("n"))
    found = F.get(F.transform(F.array(both), lambda rows: F.filter(F.transform(rows, count(rows)), lambda r: r["side"] == zero)), 0)
    return F.transform(found, lambda r: F.struct(r["id"].alias("id"), r["n"].alias("n")))


def inline_each(counts: Column | str) -> Column:
    """`inline` of the (id, n) in `counts` that hands its rows on one by one.

    Of a bare column, Spark's generated code first collects all rows that come of a set, each with a copy of the set's text, which is
    the square of the set. What has a lambda isn't compiled, so that a task holds one such row at a time.
    """
    return F.inline(F.transform(counts, lambda r: F.struct(r["id"].alias("id"), r["n"].alias("n"))))


def counted_sets(decisions: DataFrame, by: list[str] = (), sets: DataFrame | None = None) -> DataFrame:
    """A5: (by, ids, size, members, counts): a row for each candidate set, with (id, n) of its members in `counts`.

    A row of `decisions` is one decision, or as many as its column `n` says. It holds its `candidates`, or with `sets`
    (set_id, candidates) the `set_id` made by `set_name`. What is shuffled grows with
    the decisions and the sets, not with their product.
    """
    if sets is None:
        decisions = decisions.withColumn("set_id", set_name("candidates"))
        sets = decisions.groupBy("set_id").agg(F.first("candidates").alias("candidates"))
    kind = sets.schema["candidates"].dataType.elementType
    n = F.sum("n") if "n" in decisions.columns else F.count("*")
    chosen = decisions.groupBy(*by, "set_id", F.col("chosen").cast(kind).alias("id")).agg(n.cast("long").alias("n"))
    chosen = chosen.groupBy(*by, "set_id").agg(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("chosen"))
    members = sets.select("set_id", F.array_sort(F.array_distinct("candidates")).alias("members"))
    rows = chosen.join(members, "set_id").where("members IS NOT NULL")
    return rows.select(*by, F.array_join("members", ",").alias("ids"), F.size("members").alias("size"), "members", with_zeros("members", "chosen").alias("counts"))


def decision_counts(decisions: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """A5: (ids, size, members, id, n): how often each id of a candidate set was chosen, 0 included. `ids` is sorted text. See `counted_sets`."""
    return counted_sets(decisions, sets=sets).select("ids", "size", "members", inline_each("counts"))


def merge_decisions(*logs: DataFrame) -> DataFrame:
    """(ids, size, members, id, n): counts of equal sets of several logs (see `counted_sets`) added."""
    found = logs[0]
    for log in logs[1:]:
        found = found.unionByName(log)
    found = found.withColumn("set_id", F.unhex(F.md5("ids")))
    sums = found.select("set_id", F.inline("counts")).groupBy("set_id", "id").agg(F.sum("n").alias("n"))
    sums = sums.groupBy("set_id").agg(F.collect_list(F.struct("id", "n")).alias("counts"))
    sets = found.groupBy("set_id").agg(F.first("members").alias("members"))
    rows = sums.join(sets, "set_id").select(F.array_join("members", ",").alias("ids"), F.size("members").alias("size"), "members", F.array_sort("counts").alias("counts"))
    return rows.select("ids", "size", "members", inline_each("counts"))


def format_decisions(sets: DataFrame, by: list[str] = ()) -> DataFrame:
    """The log text of the counted sets of each group of `by`, ordered by size, then ids. A report has few sets."""
    text = F.concat(F.array_join(F.transform("counts", lambda r: r["id"].cast("string")), ","), F.lit(":"), F.array_join(F.transform("counts", lambda r: r["n"].cast("string")), ","))
    lines = sets.select(*by, F.struct("size", "members", text.alias("text")).alias("line")).groupBy(*by).agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return lines.select(*by, F.array_join(F.transform("lines", lambda x: x["text"]), ";").alias("log"))


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, sum, sum2, min, max, mean, stddev (sample; 0 below two values)."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.sum(v * v).alias("sum2"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stddev"))


def merge_stats(partials: DataFrame, by: list[str]) -> DataFrame:
    """The same from partial rows (count, sum, sum2, min, max), without the values."""
    out = partials.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("count", "sum", "sum2")], F.min("min").alias("min"), F.max("max").alias("max"))
    spread = (F.col("sum2") - F.col("sum") * F.col("sum") / F.col("count")) / (F.col("count") - 1)
    return out.withColumns({"mean": F.when(F.col("count") > 0, F.col("sum") / F.col("count")), "stddev": F.when(F.col("count") < 2, 0.0).otherwise(F.sqrt(F.greatest(spread, F.lit(0.0))))})


def percentiles(df: DataFrame, value: str, by: list[str], ps: list[float]) -> DataFrame:
    """A10: exact, interpolated percentiles p<k>, and the median; a group's values are never in one task (see scans)."""
    shares = {"median": 0.5} | {f"p{p:g}": min(100.0, max(0.0, p)) / 100 for p in ps}
    return exact_percentiles(df, value, by, shares)


def target_io_report(ops: DataFrame, file_size: int) -> DataFrame:
    """Per sample and target from (sample, target, kind, seconds): MB/s and min, avg, max milliseconds of reads and writes."""
    out = []
    for kind in ("read", "write"):
        s = F.when(F.col("kind") == kind, F.col("seconds"))
        out += [(file_size / (MIB * F.sum(s))).alias(f"{kind}_mbps"), (F.min(s) * 1000).alias(f"min_{kind}_ms"), (F.avg(s) * 1000).alias(f"avg_{kind}_ms"), (F.max(s) * 1000).alias(f"max_{kind}_ms")]
    return ops.groupBy("sample", "target").agg(*out)


def sample_report(ops: DataFrame) -> DataFrame:
    """Per sample the seconds of each kind."""
    total = lambda kinds: F.sum(F.when(F.col("kind").isin(kinds), F.col("seconds")).otherwise(0.0))
    return ops.groupBy("sample").agg(total(["read", "write"]).alias("data_sec"), total(["stat"]).alias("metadata_read_sec"), total(["create", "remove"]).alias("metadata_write_sec"))


def dir_counts(catalog: DataFrame) -> DataFrame:
    """Entries, files, dirs and name bytes (2 more for each name) of each parent. Types: 4 directory, 8 file."""
    count = lambda t: F.sum((F.col("type") == t).cast("long"))
    return catalog.groupBy("parent").agg(F.count("*").alias("entries"), count(8).alias("files"), count(4).alias("dirs"), F.sum(F.length("entry") + 2).cast("long").alias("name_bytes"))


def file_state(closes: DataFrame, catalog: DataFrame) -> DataFrame:
    """(path, size, mtime, atime, blocks) after close events (path, ts, max_range, mtime); blocks follow only a size that grew."""
    last = closes.groupBy("path").agg(F.max("max_range").alias("r"), F.max("mtime").alias("m"), F.max("ts").alias("a"))
    rows = catalog.select("path", "size", "mtime", "atime", "blocks").join(last, "path", "left")
    size = F.greatest("size", F.coalesce("r", F.col("size")))
    return rows.select("path", size.alias("size"), F.greatest("mtime", F.coalesce("m", F.col("mtime"))).alias("mtime"), F.coalesce("a", "atime").alias("atime"), F.when(size > F.col("size"), F.shiftright(size, 9)).otherwise(F.col("blocks")).alias("blocks"))


def space_report(catalog: DataFrame, extents: DataFrame) -> DataFrame:
    """One row: inodes and 4 KiB pages, total and free, and the longest name. An extent is one block, or a run of `blocks` of one size."""
    files = catalog.agg(F.count("*").alias("files"))
    blocks = F.col("blocks") if "blocks" in extents.columns else F.lit(1)
    used = extents.agg(F.coalesce(F.sum(F.expr("(block_size + 4095) div 4096") * blocks), F.lit(0)).alias("used"))
    n = lambda x: F.lit(x).cast("long")
    return files.crossJoin(used).select(n(INODES).alias("inodes"), (n(INODES) - F.col("files")).alias("free_inodes"), n(PAGES).alias("pages"), (n(PAGES) - F.col("used")).alias("free_pages"), F.lit(NAME_LENGTH).alias("name_length"))


def file_count(catalog: DataFrame, root: str) -> DataFrame:
    """Regular files below a root."""
    return catalog.where(F.col("path").startswith(root.rstrip("/") + "/") & (F.col("type") == 8)).agg(F.count("*").alias("files"))
