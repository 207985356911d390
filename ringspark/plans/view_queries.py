"""Queries on views of nodes, trees and files, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringspark.functions import ids
from ringspark.operators import store, views
from ringspark.plans import derived as d
from ringspark.plans.repair_queries import _CALLS, _calls, latency_rank
from ringspark.plans.repair_queries import SQL as REPAIR_SQL
from ringspark.plans.store_queries import _CHUNKS, _LEVELS, _files, _sql_root, _sql_slots
from ringspark.streaming import state

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


_BITS = "list_reduce(list_transform(string_split(substr(\"key\", 1, 40), ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), lambda a, b: a || b)"


@query(f"""with {d.KEYS}, b as (select "key", {_BITS} as bits from keys)
select "key", (case when position('000' in substr(bits, 60, 101)) > 0 then 101 - position('000' in substr(bits, 60, 101)) else -1 end)::INT as run, substr("key", 1, 30) || substr(sha1("key"), 1, 10) as mixed from b""")
def id_bit_runs(spark, sf):
    k = d.keys(spark, sf)
    return k.select("key", ids.zero_run("key", 100, 3).alias("run"), ids.replace_low_bits("key", 40, ids.hash_id("key")).alias("mixed"))


@query(f"with {d.RANKED} select a.id, a.id || ',' || string_agg(b.id, ',' order by p) as list from ranked a, (select unnest(range(1, 5)) as p) r, ranked b where b.rank = (a.rank + p) % a.n group by a.id")
def neighbour_lists(spark, sf):
    return views.neighbour_lists(d.living(spark, sf), 4).withColumn("list", F.array_join("list", ","))


@query(f"with {d.LIVING}, starts as (select id, p, {d.sql_add('id', 'pw')} as start from (select id, p, {d.sql_power('p')} as pw from living, (select unnest(range(160))::BIGINT as p) r)), f as (select id, p, coalesce((select min(l.id) from living l where l.id >= start), (select min(id) from living)) as finger from starts), g as (select id, finger, min(p) as i from f where finger <> id group by 1, 2) select id, id || ',' || string_agg(finger, ',' order by i) as list from g group by id")
def finger_lists(spark, sf):
    return views.finger_lists(d.living(spark, sf)).withColumn("list", F.array_join("list", ","))


@query(f"with {d.NODES} select vnode::INT as vnode, id, case when k % 5 = 0 then 'left' else 'right' end as side from nodes where (k % 5 = 0) <> (k % 4 = 0)")
def list_reconcile(spark, sf):
    n = d.nodes(spark, sf)
    return views.reconciled(n.where("k % 4 <> 0"), n.where("k % 5 <> 0"), ["vnode"])


_TWO = d.NODES + """, t0 as (select id, row_number() over (order by id) - 1 as rank, count(*) over () as n from nodes), t1 as (select id, row_number() over (order by id) - 1 as rank, count(*) over () as n from nodes where alive),
l0 as (select a.id, string_agg(b.id, ',' order by p) as l from t0 a, (select unnest(range(1, 4)) as p) r, t0 b where b.rank = (a.rank + p) % a.n group by a.id),
l1 as (select a.id, string_agg(b.id, ',' order by p) as l from t1 a, (select unnest(range(1, 4)) as p) r, t1 b where b.rank = (a.rank + p) % a.n group by a.id)"""


@query(f"with {_TWO} select coalesce(l0.id, l1.id) as id, coalesce(l0.l = l1.l, false) as stable from l0 full join l1 on l0.id = l1.id")
def neighbour_changes(spark, sf):
    """Which nodes see other neighbours once the dead ones are gone."""
    n = d.nodes(spark, sf)
    return views.changed(views.neighbour_lists(n, 3), views.neighbour_lists(n.where("alive"), 3))


@query(f"with {d.LIVING}, r as (select sha1(item_id::VARCHAR) as src, sha1(text) as stop from benchmark) select src, id, row_number() over (partition by src order by id < src, id)::INT as at from r, living where {d.sql_between('right', 'src', 'stop', 'id')} and id <> src qualify row_number() over (partition by src order by id < src, id) <= 5")
def nearest_in_range(spark, sf):
    r = d.table(spark, sf, "benchmark").select(F.sha1(F.col("item_id").cast("string").cast("binary")).alias("src"), ids.hash_id("text").alias("stop"))
    return views.nearest_in_range(d.living(spark, sf), r)


@query(f"with a as ({REPAIR_SQL['latency_rank']}), h as (select *, ('0x' || substr(node, 37, 4))::INT % 3 <> 0 as ok from a), b as (select *, coalesce(sum(ok::INT) over (partition by \"key\" order by choice rows between unbounded preceding and 1 preceding), 0) as before from h) select \"key\", count(*)::BIGINT as tries, count(*) filter (ok)::BIGINT as got, count(*) filter (ok) >= 2 as done from b where before < 2 group by \"key\"")
def fetch_choice(spark, sf):
    asked = latency_rank(spark, sf).withColumn("ok", F.conv(F.substring("node", 37, 4), 16, 10).cast("int") % 3 != 0)
    return views.fetch_choice(asked.select("key", "choice", "ok"), 2)


@query("select user_id, event_id, event_id - lag(event_id) over (partition by user_id order by event_id) as delta from events")
def retrieve_phases(spark, sf):
    return views.phases(d.table(spark, sf, "events"), "user_id", "event_id")


@query(f"with {_CHUNKS}, low as (select name, pos // 8 as pos, sha1(unhex(string_agg(id, '' order by pos))) as id, count(*) as n from chunks group by 1, 2) select name, sum(n)::BIGINT as n_blocks, count(*)::BIGINT as indirect, sha1(unhex(string_agg(id, '' order by pos))) as inode from low group by name")
def file_layout(spark, sf):
    return views.file_layout(store.chunks(_files(spark, sf), 1024), 8)


@query(f"with {_sql_root(_LEVELS)}, h as (" + " union all ".join(f"select {k} as depth, prefix, hash from h{k}" for k in range(6)) + "), c as (select depth - 1 as depth, substr(prefix, 1, 2 * (depth - 1)) as prefix, string_agg(substr(prefix, -2) || ':' || hash, ',' order by prefix) as children from h where depth > 0 group by 1, 2) select s.depth, s.prefix, s.n, h.hash, c.children from shape s join h using (depth, prefix) join c using (depth, prefix) where s.n > 64")
def merkle_nodes(spark, sf):
    return views.tree_nodes(d.item_keys(spark, sf)).withColumn("children", F.array_join("children", ","))


@query(f"with {_LEVELS}, w as (select distinct sha1(text) as \"key\" from benchmark), p as (" + " union all ".join(f"select \"key\", s.depth, s.n from w join shape s on s.depth = {k} and s.prefix = {_sql_slots('\"key\"', k)}" for k in range(6)) + ") select \"key\", max(depth)::INT as depth, arg_max(n <= 64, depth) as is_leaf from p where n > 0 group by \"key\"")
def merkle_lookup(spark, sf):
    return views.deepest_nodes(d.item_keys(spark, sf), d.table(spark, sf, "benchmark").select(ids.hash_id("text").alias("key")).distinct())


@query(f"with {_CALLS} select prog, sum(bytes)::BIGINT as bytes, sum(latency)::BIGINT as latency from calls where proc = 1 group by prog")
def stats_by_name(spark, sf):
    return views.summed_stats(_calls(spark, sf).withColumnRenamed("proc", "vnode"), "prog", ["bytes", "latency"], 1)


@query("select time_bucket(interval '1 second', ts)::TIMESTAMP as start, count(*)::BIGINT as n, round(sum(value), 4) as total from events group by 1")
def stream_bandwidth(spark, sf):
    out = state.run(state.rate(state.events(spark, sf), "1 second"), "complete")
    return out.withColumns({"total": F.round("total", 4), "start": F.col("start").cast("timestamp_ntz")})


@query(f"with {d.REPLICAS}, c as (select \"key\", count(distinct node) as n from holdings group by 1) select n::BIGINT as copies, count(*)::BIGINT as keys, (n >= 2) as enough from c group by n")
def replica_check(spark, sf):
    from ringspark.operators import repair

    c = repair.replica_counts(d.holdings(spark, sf))
    return c.groupBy("copies").agg(F.count("*").alias("keys")).withColumn("enough", F.col("copies") >= 2)


