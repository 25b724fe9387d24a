"""Where paths and byte ranges land: home servers, stripes, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scans import unfolded
from .scalars import ROOT
from .xxh64 import unsigned_mod, xxh64

# Bytes of a stripe and of a page.
STRIPE, PAGE = 2097152, 1048576


def xxh64_mod(path: Column, n: int) -> Column:
    """XXH64 with seed 0, as an unsigned number, modulo n."""
    return unsigned_mod(xxh64(path), n)


def md5_mod(path: Column, n: int) -> Column:
    """The first 15 hex digits of the MD5 modulo n."""
    return (F.conv(F.substring(F.md5(path), 1, 15), 16, 10).cast("long") % n).cast("int")


def place(path: Column, n_servers: int, hash: str = "xxh64", root: str = ROOT, variant: str = "server") -> Column:
    """The home server of a path: by its "_S" or ".00" tag if that names a server, else by hash.

    The two sides read tags differently. A server takes two hexadecimal digits
    after "_S", then a ".00" number, each if it is below `n_servers`; the root goes
    by hash. A client (`variant="client"`) takes one hexadecimal digit after "_S", but a
    ".00" number, modulo `n_servers`, goes before it; the root is a path like any other.
    """
    hashed = {"xxh64": xxh64_mod, "md5": md5_mod}[hash](path, n_servers)
    found = lambda pattern, group, base: F.conv(F.nullif(F.regexp_extract(path, pattern, group), F.lit("")), base, 10).cast("int")
    number = F.nullif(F.regexp_extract(F.substring(path, -9, 9), r"^\.00([0-9]{1,6})(?![0-9]).{0,5}$", 1), F.lit("")).cast("int")
    number = F.when(F.length(path) > 10, number)
    if variant == "client":
        digit = found(r"_S([0-9a-fA-F])$", 1, 16)
        return F.coalesce(number % n_servers, F.when(digit < n_servers, digit), hashed)
    if variant != "server":
        raise ValueError(f"unknown variant {variant!r}: server or client")
    tag = F.coalesce(found(r"_S([0-9a-fA-F]{2})$", 1, 16), found(r"_S([0-9a-fA-F])[^0-9a-fA-F]$", 1, 16))
    return F.when(path == root, hashed).when(tag < n_servers, tag).when(number < n_servers, number).otherwise(hashed)


def stripe_requests(requests: DataFrame, n_servers: int, stripe: int = STRIPE) -> DataFrame:
    """Requests (…, home, off, nlen) cut at stripe boundaries: adds shift, piece_off, piece_len, server. A length of 0 gives one piece of 0."""
    first, last = F.expr(f"off div {stripe}"), F.expr(f"(off + greatest(nlen, 1) - 1) div {stripe}")
    rows = unfolded(requests, "shift", first, last)
    rows = rows.withColumn("piece_off", F.greatest("off", F.col("shift") * stripe))
    rows = rows.withColumn("piece_len", F.least(F.col("off") + F.col("nlen"), (F.col("shift") + 1) * stripe) - F.col("piece_off"))
    return rows.withColumn("server", ((F.col("home") + F.col("shift")) % n_servers).cast("int"))


def page_spans(requests: DataFrame, page: int = PAGE, clamp_to: str | None = None) -> DataFrame:
    """P10: a row for each page a request touches: page_id, page_offset, copy_len; reads are cut at the size in `clamp_to`."""
    rows = requests
    if clamp_to:
        rows = rows.withColumn("nlen", F.least("nlen", F.col(clamp_to) - F.col("off")))
    rows = rows.where("nlen > 0").withColumn("page_id", F.explode(F.sequence(F.expr(f"off div {page}"), F.expr(f"(off + nlen - 1) div {page}"))))
    start = F.greatest("off", F.col("page_id") * page)
    return rows.withColumns({"page_offset": start - F.col("page_id") * page, "copy_len": F.least(F.col("off") + F.col("nlen"), (F.col("page_id") + 1) * page) - start})


def delete_fanout(files: DataFrame, n_servers: int, stripe: int = STRIPE) -> DataFrame:
    """For each deleted file (…, home, size) of more than a stripe, the other servers that hold pieces."""
    most = F.least(F.expr(f"(size + {stripe} - 1) div {stripe}"), F.lit(n_servers - 1).cast("long"))
    rows = files.where((F.col("size") > stripe) & (F.lit(n_servers) > 1)).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), most)))
    return rows.withColumn("server", ((F.col("home") + F.col("k")) % n_servers).cast("int")).drop("k")


def server_load(requests: DataFrame, n_servers: int, by: list[str] = (), stripe: int = STRIPE) -> DataFrame:
    """Pieces and bytes per server (and `by`) after striping; combined before the shuffle."""
    return stripe_requests(requests, n_servers, stripe).groupBy("server", *by).agg(F.count("*").alias("pieces"), F.sum("piece_len").alias("bytes"))
