"""Readers of benchmark reports, decision logs, sample tables and traces.

Each `parse_*` takes lines (column `value`, and `line`, their order, where it
counts); each `read_*` takes a path. Files are many and small or few and large;
lines are parsed where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ROOT, parse_report_time, parse_size
from ..operators.aggregates import inline_each


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): `line` rises within a file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value")


def _field(name: str, kind: str) -> Column:
    return F.nullif(F.regexp_extract("value", rf"(?:^|\s)-?{name}=(\S*)", 1), F.lit("")).try_cast(kind)


def parse_run_reports(lines: DataFrame, strip_comment: bool = True) -> DataFrame:
    """(…, tag, end_s, nn, np, user, jobid, mbps, mbps_rank_stddev, slices) of the lines that start with rw_speed."""
    text = F.regexp_replace("value", r"^# ", "") if strip_comment else F.col("value")
    rows = lines.withColumn("value", text).where(F.col("value").startswith("rw_speed."))
    slices = F.transform(F.split(F.regexp_extract("value", r"mbps_1sec_time_slices=\(([^)]*)\)", 1), ","), lambda x: x.try_cast("double"))
    return rows.select(
        *[c for c in lines.columns if c != "value"], F.regexp_extract("value", r"^rw_speed\.(\S*)", 1).alias("tag"), parse_report_time(_field("time", "string")).alias("end_s"),
        _field("nn", "int").alias("nn"), _field("np", "int").alias("np"), _field("user", "bigint").alias("user"), _field("jobid", "int").alias("jobid"),
        _field("mbps", "double").alias("mbps"), _field("mbps_rank_stddev", "double").alias("mbps_rank_stddev"), F.filter(slices, lambda x: x.isNotNull()).alias("slices"),
    )


def read_run_reports(spark: SparkSession, path: str, strip_comment: bool = True) -> DataFrame:
    return parse_run_reports(lines_of(spark, path), strip_comment)


def parse_run_headers(lines: DataFrame) -> DataFrame:
    """The settings printed before a run."""
    rows = lines.where(F.col("value").startswith("rw_speed time="))
    return rows.select(
        *[c for c in lines.columns if c != "value"], _field("tag", "string").alias("tag"), parse_report_time(F.regexp_extract("value", r"^rw_speed time=(\S*)", 1)).alias("start_s"),
        _field("np", "int").alias("np"), _field("nn", "int").alias("nn"), _field("sim_nn", "int").alias("sim_nn"), _field("rank0host", "string").alias("rank0host"), _field("prefix", "string").alias("prefix"),
        parse_size(_field("iosize", "string")).alias("iosize"), parse_size(_field("filesize", "string")).alias("filesize"), F.regexp_extract("value", r" -time=(\S*)", 1).try_cast("double").alias("run_time"),
    )


def read_run_headers(spark: SparkSession, path: str) -> DataFrame:
    return parse_run_headers(lines_of(spark, path))


#: A decision-log line, its sets of ids and counts, a printed request.
DECISION_FORM = r"reportDecisionLog rank (\d+) time=([0-9.]+) ?(.*)$"
SET_FORM = r"^-?\d++(?:,-?\d++)*+:-?\d++(?:,-?\d++)*+$"  # possessive, as a set may have more ids than the stack has room for
REQUEST_FORM = r"^(.*) msg tid=(-?\d+) tag=(-?\d+) name=(.*) jobidx=(-?\d+) time=([0-9.]+) content=[0-9a-f]*$"


def rejected_lines(lines: DataFrame, reader: str, strip_comment: bool = True) -> DataFrame:
    """`lines` that are meant for a reader but lack what it needs, with the `reason`: the first that holds.

    `reader` is run_reports (S1), decision_log (S3), interval_reports (S8) or request_trace (S9). Lines of
    other programs are no rejects. What is not rejected has a row, or as many as it has sets and ids.
    """
    text = F.regexp_replace("value", r"^# ", "") if strip_comment and reader == "run_reports" else F.col("value")
    value, number = F.col("_text"), r"-?[0-9.]+(?:[eE][-+]?\d+)?"
    sets = F.filter(F.split(F.regexp_extract("_text", DECISION_FORM, 3), ";"), lambda x: x != "")
    many = lambda x, i: F.size(F.split(F.get(F.split(x, ":"), F.lit(i)), ","))
    checks = {
        "run_reports": (
            value.startswith("rw_speed."),
            {
                "no tag": ~value.rlike(r"^rw_speed\.\S"),
                "no end time": parse_report_time(F.regexp_extract("_text", r"(?:^|\s)time=(\S*)", 1)) == 0,
                "no slices": ~value.rlike(r"mbps_1sec_time_slices=\([^)]*\)"),
                "bad slices": ~value.rlike(rf"mbps_1sec_time_slices=\({number}(?:,{number})*\)"),
            },
        ),
        "decision_log": (
            value.contains("reportDecisionLog"),
            {
                "bad head": ~value.rlike(DECISION_FORM),
                "bad set": F.exists(sets, lambda x: ~x.rlike(SET_FORM)),
                "ids and counts differ": F.exists(sets, lambda x: many(x, 0) != many(x, 1)),
            },
        ),
        "interval_reports": (
            value.rlike(r"^T = |^INFO> Reporting performance"),
            {"no time": ~value.rlike(r"\bT = +[0-9.]+"), "no rate": ~value.rlike(r"[0-9.]+ M IOPS|performance +[0-9.]+ M iops")},
        ),
        "request_trace": (value.contains(" msg tid="), {"bad form": ~value.rlike(REQUEST_FORM)}),
    }
    if reader not in checks:
        raise ValueError(f"no reader {reader!r}: one of {', '.join(checks)}")
    meant, faults = checks[reader]
    reason = F.coalesce(*[F.when(fault, F.lit(name)) for name, fault in faults.items()])
    return lines.withColumn("_text", text).where(meant).withColumn("reason", reason).where("reason IS NOT NULL").drop("_text")


def parse_decision_log(lines: DataFrame) -> DataFrame:
    """S3: (rank, time_s, ids, size, members, id, n): a row for each set and id of a decision-log line; sets without that form give none."""
    form = DECISION_FORM
    rows = lines.where(F.col("value").rlike(form)).select(F.regexp_extract("value", form, 1).cast("int").alias("rank"), F.regexp_extract("value", form, 2).cast("double").alias("time_s"), F.explode(F.split(F.regexp_extract("value", form, 3), ";")).alias("part"))
    pair = F.split("part", ":")
    ids, ns = (F.transform(F.split(pair[i], ","), lambda x: x.try_cast("long")) for i in (0, 1))
    rows = rows.where(F.col("part").rlike(SET_FORM)).where(F.size(ids) == F.size(ns))
    rows = rows.select("rank", "time_s", pair[0].alias("ids"), F.size(ids).alias("size"), ids.alias("members"), F.zip_with(ids, ns, lambda i, n: F.struct(i.alias("id"), n.alias("n"))).alias("counts"))
    return rows.select("rank", "time_s", "ids", "size", "members", inline_each("counts"))  # a set is taken apart once, not for each of its ids


def read_decision_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_decision_log(lines_of(spark, path))


def long_slices(wide: DataFrame) -> DataFrame:
    """(time_in_seconds, tag, mbps) of a wide table with a column <tag>.mbps for each tag."""
    wide = wide.toDF(*[c.removesuffix(".mbps") for c in wide.columns])
    tags = [c for c in wide.columns if c != "time_in_seconds"]
    long = wide.select("time_in_seconds", *[F.col(f"`{t}`").cast("string") for t in tags]).unpivot(["time_in_seconds"], tags, "tag", "mbps")
    return long.select(F.col("time_in_seconds").cast("int"), "tag", F.col("mbps").cast("double"))


def read_slice_table(spark: SparkSession, path: str) -> DataFrame:
    """S4"""
    return long_slices(spark.read.csv(path, sep="\t", header=True))


def slice_table(slices: DataFrame) -> DataFrame:
    """The wide form, tags sorted, one decimal. Tags are columns, so they are looked up first."""
    tags = sorted(r[0] for r in slices.select("tag").distinct().collect())
    wide = slices.groupBy("time_in_seconds").pivot("tag", tags).agg(F.first("mbps"))
    return wide.select("time_in_seconds", *[F.format_string("%.1f", F.coalesce(F.col(f"`{t}`"), F.lit(0.0))).alias(f"{t}.mbps") for t in tags]).orderBy("time_in_seconds")


def write_slice_table(slices: DataFrame, path: str) -> None:
    """One file for a run's few rows."""
    slice_table(slices).coalesce(1).write.csv(path, sep="\t", header=True, mode="overwrite")


def long_scaling(wide: DataFrame) -> DataFrame:
    """(nodes, policy, direction, mbps) of a wide table with a column "<policy> <direction>" for each series."""
    long = wide.withColumnRenamed("node count", "nodes").unpivot(["nodes"], [c for c in wide.columns if c != "node count"], "series", "mbps")
    return long.select(F.col("nodes").cast("int"), F.substring_index("series", " ", 1).alias("policy"), F.substring_index("series", " ", -1).alias("direction"), F.col("mbps").cast("double"))


def read_scaling(spark: SparkSession, path: str) -> DataFrame:
    """S5"""
    return long_scaling(spark.read.csv(path, header=True))


def parse_table(lines: DataFrame, names: list[str]) -> DataFrame:
    """Tab-separated rows below # headers: ts, its epoch seconds, and double columns."""
    parts = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    return rows.select(*[c for c in lines.columns if c != "value"], parts[0].alias("ts"), parse_report_time(parts[0]).alias("t"), *[F.get(parts, i + 1).try_cast("double").alias(n) for i, n in enumerate(names)])


VARIABILITY = ["data_sec", "metadata_read_sec", "metadata_write_sec"]
TARGET_IO = [f"{x}{k}{y}" for k in ("read", "write") for x, y in (("", "_mbps"), ("min_", "_ms"), ("avg_", "_ms"), ("max_", "_ms"))]


def read_variability(spark: SparkSession, path: str) -> DataFrame:
    """S6"""
    return parse_table(lines_of(spark, path).drop("file", "line"), VARIABILITY)


def parse_target_io(lines: DataFrame) -> DataFrame:
    """Rows of (file, value) with `target` from the end of the file name."""
    rows = parse_table(lines.select("file", "value"), TARGET_IO)
    return rows.withColumn("target", F.regexp_extract("file", r"ost(\d+)$", 1).cast("int")).drop("file").withColumnRenamed("ts", "sample")


def read_target_io(spark: SparkSession, path: str) -> DataFrame:
    """S7"""
    return parse_target_io(lines_of(spark, path))


def parse_interval_reports(lines: DataFrame) -> DataFrame:
    """(t, gbps, miops, reduce_us, ops_accum_m, kind) of the three report forms."""
    number = lambda form: F.nullif(F.regexp_extract("value", form, 1), F.lit("")).try_cast("double")
    rows = lines.where(F.col("value").rlike(r"^T = |^INFO> Reporting performance"))
    gbps = number(r"Bandwidth = +([0-9.]+) GB/s")
    kind = F.when(F.col("value").startswith("INFO>"), "server").when(gbps.isNotNull(), "io").otherwise("stat")
    return rows.select(number(r"\bT = +([0-9.]+)").alias("t"), gbps.alias("gbps"), F.coalesce(number(r"([0-9.]+) M IOPS"), number(r"performance +([0-9.]+) M iops")).alias("miops"), number(r"T_Reduce = +([0-9.]+) us").alias("reduce_us"), number(r"nOP_Accu = +([0-9.]+)").alias("ops_accum_m"), kind.alias("kind"))


def read_interval_reports(spark: SparkSession, path: str) -> DataFrame:
    return parse_interval_reports(lines_of(spark, path))


def parse_request_trace(lines: DataFrame) -> DataFrame:
    """(stage, tid, tag, op_name, jobidx, t) of printed requests; the hex content stays behind."""
    form = REQUEST_FORM
    part = lambda i: F.regexp_extract("value", form, i)
    return lines.where(F.col("value").rlike(form)).select(part(1).alias("stage"), part(2).cast("int").alias("tid"), part(3).cast("int").alias("tag"), F.trim(F.translate(part(4), "\t", "")).alias("op_name"), part(5).cast("int").alias("jobidx"), part(6).cast("double").alias("t"))


def read_request_trace(spark: SparkSession, path: str) -> DataFrame:
    return parse_request_trace(lines_of(spark, path))


def parse_dir_list(lines: DataFrame, root: str = ROOT) -> DataFrame:
    """(path, type) of relative directory names, CRLF or LF."""
    return lines.select(F.regexp_replace("value", r"\r$", "").alias("value")).where("value <> ''").select(F.concat_ws("/", F.lit(root), "value").alias("path"), F.lit(4).alias("type"))


def read_dir_list(spark: SparkSession, path: str, root: str = ROOT) -> DataFrame:
    return parse_dir_list(lines_of(spark, path), root)
