"""Column functions over requests, paths and report text. Null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size suffixes, operation codes with their names, the mark of a request, the root, the inline limit.
SIZE_SUFFIXES = {"": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50, "x": 60}
OP_NAMES = {
    0x00: "open(read-only)", 0x01: "close(read-only)", 0x02: "done(read-only)",
    0x11: "open", 0x12: "read", 0x13: "write", 0x14: "close", 0x15: "stat", 0x16: "lstat", 0x17: "remove_file", 0x18: "remove_dir",
    0x19: "mkdir", 0x1A: "opendir", 0x1B: "addentry_parent_dir", 0x1C: "removeentry_parent_dir", 0x1D: "dir_exist", 0x1E: "seek", 0x1F: "fstat",
    0x21: "file_allocate", 0x22: "posix_file_allocate", 0x23: "truncate", 0x24: "ftruncate", 0x25: "fsync", 0x26: "posix_fadvise", 0x27: "faccessat",
    0x28: "pread", 0x29: "pwrite", 0x2A: "futimens", 0x2B: "utimes", 0x2C: "free_stripe_data", 0x2D: "stat_fs", 0x2E: "read_dir_entries",
    0x4E: "hello", 0x4F: "print_mem", 0x50: "disconnect",
}
OP_LIMIT = 81
DISPATCHED = ["open", "close", "opendir", "read", "write", "stat", "lstat", "fstat", "remove_file", "remove_dir", "mkdir", "truncate", "ftruncate", "futimens", "utimes", "addentry_parent_dir", "removeentry_parent_dir", "dir_exist", "free_stripe_data", "print_mem", "hello", "stat_fs", "read_dir_entries", "disconnect"]
REQUEST_MARK = 0x78563400
ROOT = "/myfs"
INLINE_LIMIT = 335872


def epoch_seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp column, with or without time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def parse_size(col: Column) -> Column:
    """Bytes of "64k", "1.5g" and the like; what follows the suffix letter is ignored; null if it doesn't parse or overflows."""
    number = F.regexp_extract(col, r"^([0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?)(.?)", 1)
    suffix = F.lower(F.regexp_extract(col, r"^(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?)(.?)", 1))
    factor = F.lit(None).cast("double")
    for letter, power in SIZE_SUFFIXES.items():
        factor = F.when(suffix == letter, F.lit(float(2**power))).otherwise(factor)
    return (number.try_cast("double") * factor).try_cast("bigint")


def parse_report_time(col: Column) -> Column:
    """Epoch seconds of "2021-08-17:21:41:18"; 0 where it isn't one."""
    shaped = F.when(col.rlike(r"^\d{4}-\d{1,2}-\d{1,2}:\d{1,2}:\d{1,2}:\d{1,2}$"), col)
    return F.coalesce(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.try_to_timestamp(shaped, F.lit("yyyy-M-d:H:m:s")).cast("timestamp_ntz")), F.lit(0)).cast("long")


def op_name(op: Column) -> Column:
    """The name of an operation code, of which the low byte counts."""
    code = op.bitwiseAND(255)
    names = F.create_map(*[F.lit(x) for kv in OP_NAMES.items() for x in kv])
    return F.when(code >= OP_LIMIT, "invalid_op_code").otherwise(F.coalesce(F.try_element_at(names, code.cast("int")), F.concat(F.lit("unknown-op-"), code.cast("string"))))


def op_supported(op: Column) -> Column:
    """Whether a request with this operation word is a real one that is handled."""
    codes = [code for code, name in OP_NAMES.items() if name in DISPATCHED]
    return (op.cast("long").bitwiseAND(0xFFFFFF00) == REQUEST_MARK) & op.bitwiseAND(255).isin(codes)


def valid_requests(requests: DataFrame, op: str = "op") -> DataFrame:
    return requests.where(op_supported(F.col(op)))


def canonical_path(col: Column, cwd: str = "/") -> Column:
    """P5: an absolute path without empty, "." and ".." parts; ".." never climbs above the root."""
    whole = F.when(col.startswith("/"), col).otherwise(F.concat(F.lit(cwd.rstrip("/") + "/"), col))
    parts = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def split_path(col: Column, root: str = ROOT) -> Column:
    """Struct (parent, entry, parent_len, entry_len); the root has an empty parent."""
    parent = F.when(col == root, F.lit("")).otherwise(F.regexp_extract(col, r"^(.*?)/+[^/]*/*$", 1))
    entry = F.when(col == root, col).otherwise(F.regexp_extract(col, r"([^/]*)/*$", 1))
    return F.struct(parent.alias("parent"), entry.alias("entry"), F.length(parent).alias("parent_len"), F.length(entry).alias("entry_len"))


def on_mount(col: Column, root: str = ROOT, strict: bool = False) -> Column:
    """Whether a canonical path lies under the root; not strict, "/myfsX" counts too."""
    return ((col == root) | col.startswith(root + "/")) if strict else col.startswith(root)


def transfer_class(nlen: Column) -> Column:
    """P11"""
    return F.when(nlen <= INLINE_LIMIT, "inline").when(nlen > INLINE_LIMIT, "direct")


def short_host(col: Column) -> Column:
    """P12"""
    return F.substring_index(col, ".", 1)
