"""Workloads of the engine made from the given tables: nodes, keys, holdings. Each has its SQL twin for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringspark.functions import ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, host, port, vnode, alive, k: one for each supplier, three virtual nodes each; every seventh supplier is dead."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    host = F.concat(F.lit("10.0."), F.floor(F.col("k") / 256).cast("string"), F.lit("."), (F.col("k") % 256).cast("string"))
    s = s.select("k", host.alias("host"), F.lit(3250).alias("port"), F.explode(F.array(*map(F.lit, range(3)))).alias("vnode"))
    return s.select(ids.node_id("host", "port", "vnode").alias("id"), "host", "port", "vnode", (F.col("k") % 7 != 0).alias("alive"), "k")


def living(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("alive")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, size: the content ids of all documents, each once."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(ids.hash_id("text").alias("key")).agg(F.max(F.octet_length("text")).cast("long").alias("size"))


def item_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id of each line item, for volume."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return line.select(F.sha1(F.concat_ws(".", "l_orderkey", "l_linenumber").cast("binary")).alias("id")).distinct()


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ns, id, size, expiration, seq: what orders write to a keyed store; a key comes more than once, some never expire."""
    o = table(spark, sf_dir, "orders")
    life = F.when(F.col("o_orderstatus") == "F", 86400).when(F.col("o_orderstatus") == "O", 7 * 86400).otherwise(30 * 86400)
    return o.select(
        F.col("o_orderstatus").alias("ns"),
        F.sha1((F.col("o_orderkey") % 997).cast("string").cast("binary")).alias("id"),
        F.floor("o_totalprice").cast("long").alias("size"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(0)).otherwise(F.unix_timestamp("o_orderdate") + life).cast("long").alias("expiration"),
        F.col("o_orderkey").cast("long").alias("seq"),
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, host, key, replica: three copies of each key, a fifth of them lost."""
    from ringspark.operators import ring

    placed = ring.replicas(keys(spark, sf_dir), living(spark, sf_dir), 6, 3)
    lost = (F.conv(F.substring("key", 33, 8), 16, 10).cast("long") + F.col("replica")) % 5 == 0
    return placed.where(~lost).select("node", "host", "key", "replica", "owner")


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodes with x, y, ht: places in a plane, from the node's id."""
    part = lambda i: (F.conv(F.substring("id", i, 4), 16, 10).cast("double") / 100.0)
    return living(spark, sf_dir).select("id", "host", part(1).alias("x"), part(5).alias("y"), (part(9) / 10.0 + 100.0).alias("ht"))


# The same in DuckDB's SQL, as common table expressions.
NODES = """nodes as (select sha1(host || '.3250.' || vnode) as id, host, 3250 as port, vnode, k % 7 <> 0 as alive, k from
 (select s_suppkey as k, '10.0.' || (s_suppkey // 256) || '.' || (s_suppkey % 256) as host from supplier) s, (select unnest([0, 1, 2]) as vnode) v)"""
LIVING = NODES + ", living as (select * from nodes where alive)"
KEYS = "keys as (select sha1(text) as \"key\", max(octet_length(encode(text)))::BIGINT as size from documents where text is not null group by 1)"
OWNED = LIVING + ", " + KEYS + """, owned as (select k."key", k.size, coalesce((select min(id) from living where id >= k."key"), (select min(id) from living)) as owner,
 coalesce((select max(id) from living where id < k."key"), (select max(id) from living)) as owner_pred from keys k)"""
RANKED = LIVING + ", ranked as (select id, host, row_number() over (order by id) - 1 as rank, count(*) over () as n from living)"
ITEMS = "items as (select distinct sha1(l_orderkey || '.' || l_linenumber) as id from lineitem)"
OBJECTS = """objects as (select o_orderstatus as ns, sha1((o_orderkey % 997)::VARCHAR) as id, floor(o_totalprice)::BIGINT as size,
 (case when o_orderkey % 11 = 0 then 0 else epoch(o_orderdate) + case o_orderstatus when 'F' then 86400 when 'O' then 604800 else 2592000 end end)::BIGINT as expiration,
 o_orderkey::BIGINT as seq from orders)"""
REPLICAS = OWNED + """, ranked as (select id, host, row_number() over (order by id) - 1 as rank, count(*) over () as n from living),
 listed as (select a.id as owner, k, b.id as node, b.host from ranked a, (select unnest(range(6)) as k) r, ranked b where k < a.n and b.rank = (a.rank + k) % a.n),
 uniq as (select * from listed qualify row_number() over (partition by owner, host order by k) = 1),
 chosen as (select *, row_number() over (partition by owner order by k) - 1 as replica from uniq qualify replica < 3),
 replicas as (select o."key", o.size, c.replica::BIGINT as replica, c.node, c.host, o.owner from owned o join chosen c using (owner)),
 holdings as (select node, host, "key", replica, owner from replicas where (('0x' || substr("key", 33, 8))::BIGINT + replica) % 5 <> 0)"""
COORDINATES = LIVING + """, places as (select id, host, ('0x' || substr(id, 1, 4))::BIGINT / 100.0::DOUBLE as x, ('0x' || substr(id, 5, 4))::BIGINT / 100.0::DOUBLE as y,
 ('0x' || substr(id, 9, 4))::BIGINT / 100.0::DOUBLE / 10.0::DOUBLE + 100.0::DOUBLE as ht from living)"""


def limb(x: str, i: int) -> str:
    return f"('0x' || substr({x}, {1 + 8 * i}, 8))::BIGINT"


def sql_add(a: str, b: str) -> str:
    """a + b mod 2^160 in DuckDB's SQL."""
    carry, out = "0", []
    for i in reversed(range(5)):
        total = f"({limb(a, i)} + {limb(b, i)} + {carry})"
        out.append(f"printf('%08x', {total} & 4294967295)")
        carry = f"({total} >> 32)"
    return "(" + " || ".join(reversed(out)) + ")"


def sql_subtract(a: str, b: str) -> str:
    borrow, out = "0", []
    for i in reversed(range(5)):
        total = f"({limb(a, i)} - {limb(b, i)} - {borrow})"
        out.append(f"printf('%08x', {total} & 4294967295)")
        borrow = f"(case when {total} < 0 then 1 else 0 end)"
    return "(" + " || ".join(reversed(out)) + ")"


def sql_distance(a: str, b: str) -> str:
    return f"(case when {a} = {b} then '1' || repeat('0', 40) else {sql_subtract(b, a)} end)"


def sql_power(p: str) -> str:
    return f"(repeat('0', (39 - {p} // 4)::INT) || substr('1248', ({p} % 4 + 1)::INT, 1) || repeat('0', ({p} // 4)::INT))"


def sql_between(kind: str, a: str, b: str, n: str) -> str:
    lo, hi = (">=" if kind in ("left", "both") else ">"), ("<=" if kind in ("right", "both") else "<")
    same = f"{n} <> {a}" if kind == "open" else "true"
    return f"(case when {a} = {b} then {same} when {a} < {b} then {n} {lo} {a} and {n} {hi} {b} else {n} {lo} {a} or {n} {hi} {b} end)"
