"""Views of the star-schema tables as traces of shared storage: one SQL text for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "jobs": "SELECT s_suppkey AS jobid, s_nationkey AS uid, n_regionkey AS gid, CAST(1 + s_suppkey % 8 AS INT) AS nnode, s_suppkey AS seq FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey",
    "trace": "SELECT l_suppkey AS jobid, l_shipdate AS day, CASE WHEN l_returnflag = 'R' THEN 18 ELSE 19 END AS op, concat('/myfs/o', l_orderkey) AS path, l_partkey * 65536 AS off, CAST(l_quantity * 131072 AS BIGINT) AS nlen, l_linenumber AS server, l_orderkey AS okey, l_partkey AS pkey, l_extendedprice AS price FROM {lineitem}",
    "ev": "SELECT event_id AS req_id, ts, user_id AS uid, user_id AS jobid, event_type AS op_name, CAST(round(value * 1024) AS BIGINT) AS nlen FROM {events}",
    "ev_jobs": "SELECT c_custkey AS jobid, c_custkey AS uid, c_nationkey AS gid, CAST(1 + c_custkey % 8 AS INT) AS nnode, c_custkey AS seq FROM {customer}",
    "io_ops": "SELECT l_shipdate AS sample, CAST(l_suppkey % 16 AS INT) AS target, CASE WHEN l_returnflag = 'R' THEN 'read' WHEN l_returnflag = 'A' THEN 'write' ELSE 'stat' END AS kind, l_extendedprice / 1000000 AS seconds FROM {lineitem}",
    "catalog": "SELECT concat('/myfs/c', c_custkey) AS path, 4 AS type, CAST(0 AS BIGINT) AS size, '/myfs' AS parent, concat('c', c_custkey) AS entry FROM {customer} UNION ALL SELECT concat('/myfs/c', o_custkey, '/o', o_orderkey) AS path, 8 AS type, CAST(floor(o_totalprice) AS BIGINT) AS size, concat('/myfs/c', o_custkey) AS parent, concat('o', o_orderkey) AS entry FROM {orders} WHERE o_orderstatus <> 'F'",
    "connections": "SELECT o_orderkey AS conn_id, o_custkey AS jobid, o_custkey % 100 AS uid, o_custkey % 7 AS gid, CAST(1 + o_orderkey % 8 AS INT) AS nnode, o_orderdate AS day FROM {orders}",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tables_of(sql: str) -> list[str]:
    return [t for t in TABLES if f"{{{t}}}" in sql]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)})


def oracle(sql: str) -> str:
    """`sql` with the views it names put before it, for an engine that has the tables."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    heads = [f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in used]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join([*heads, body[5:]])
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body
