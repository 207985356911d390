"""Queries on failures: routes around dead nodes, losses that fade, budgets, states by name; and on drawn rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringspark.functions import ids
from ringspark.operators import measures, merkle, ring
from ringspark.plans import derived as d
from ringspark.plans.repair_queries import _CALLS, _calls, sql_fold
from ringspark.plans.ring_queries import _AROUND
from ringspark.plans.store_queries import _LEVELS

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


#: As the routes of ring_queries, but in tables of all nodes; dead ones beyond the furthest living one before the key have been asked.
_FAILED = "recursive " + _AROUND + f""", every as (select id, alive, row_number() over (order by id) - 1 as rank, count(*) over () as n from nodes),
starts as (select id, {d.sql_add('id', 'pw')} as start from (select id, {d.sql_power('p')} as pw from living, (select unnest(range(160))::BIGINT as p) r)),
pairs as (select id, coalesce((select min(l.id) from nodes l where l.id >= start), (select min(id) from nodes)) as nb from starts
 union select a.id, b.id from every a, (select unnest(range(1, 5)) as p) r, every b where p < a.n and b.rank = (a.rank + p) % a.n union select id, succ from around),
known as (select p.id, p.nb, e.alive from pairs p join every e on e.id = p.nb where p.nb <> p.id),
{d.KEYS}, asked as (select coalesce((select min(id) from living where id >= sha1("key")), (select min(id) from living)) as src, "key" from keys),
steps as (select src, "key", src as cur, src as path, []::VARCHAR[] as failed, false as done from asked
 union all select src, "key", nxt, path || ',' || nxt, case when ends then failed else list_distinct(list_concat(failed, list_filter(coalesce(lost, []), lambda x: (x < cur, x) > (nxt < cur, nxt)))) end, ends
 from (select s.src, s."key", s.path, s.failed, s.cur, {d.sql_between('right', 's.cur', 'a.succ', 's."key"')} as ends, list(k.nb) filter (not k.alive and {d.sql_between('open', 's.cur', 's."key"', 'k.nb')}) as lost,
  case when {d.sql_between('right', 's.cur', 'a.succ', 's."key"')} then a.succ else arg_max(k.nb, (k.nb < s.cur, k.nb)) filter (k.alive and {d.sql_between('open', 's.cur', 's."key"', 'k.nb')}) end as nxt
  from steps s join around a on a.id = s.cur join known k on k.id = s.cur where not s.done group by s.src, s."key", s.path, s.failed, s.cur, a.succ)),
routes as (select src, "key", path, cur as owner, (length(path) - length(replace(path, ',', '')))::BIGINT as hops, failed from steps where done)"""


@query(f"with {_FAILED} select src, \"key\", path, owner, hops, array_to_string(list_sort(failed), ',') as failed from routes")
def route_failures(spark, sf):
    """A lookup for each key through tables that still name dead nodes."""
    nodes = d.nodes(spark, sf)
    keys = d.keys(spark, sf).select("key").withColumn("start", F.sha1(F.col("key").cast("binary")))
    asked = ring.owners(keys, d.living(spark, sf), "start").select(F.col("owner").alias("src"), "key")
    found = ring.routes(asked, d.living(spark, sf).select("id"), dead=nodes.where("not alive").select("id"))
    return found.select("src", "key", F.array_join("path", ",").alias("path"), "owner", "hops", F.array_join("failed", ",").alias("failed"))


_GONE = "(case when s.m < 0 then 0 else (e.t - s.m) // 5 end)"
_LEFT = f"((s.l >> least({_GONE}, 62)) + 1)"
_MARK = f"(case when s.m < 0 then e.t else s.m + 5 * {_GONE} end)"


@query("select dst, s.a = 1 as alive, s.l::BIGINT as losses from (" + sql_fold("{'a': (prog <> 'error')::BIGINT, 'l': 0::BIGINT, 'm': 0::BIGINT, 't': floor(epoch(ts))::BIGINT // 20000}", "{'a': 1::BIGINT, 'l': 0::BIGINT, 'm': (-1)::BIGINT, 't': 0::BIGINT}", f"case when e.a = 1 then {{'a': 1::BIGINT, 'l': s.l, 'm': s.m, 't': 0::BIGINT}} when s.a = 0 then s when {_LEFT} > 4 then {{'a': 0::BIGINT, 'l': {_LEFT}::BIGINT, 'm': e.t, 't': 0::BIGINT}} else {{'a': 1::BIGINT, 'l': {_LEFT}::BIGINT, 'm': {_MARK}::BIGINT, 't': 0::BIGINT}} end") + ")")
def faded_losses(spark, sf):
    """Losses of each host that fade with time; a tick is 20,000 seconds, as events are far apart."""
    s = _calls(spark, sf).select("dst", "ts", "event_id", (F.col("prog") == "error").alias("lost"), F.floor(F.unix_timestamp("ts") / 20000).alias("at"))
    return measures.decayed_losses(s, ["dst"], ["ts", "event_id"], "lost", "at", "dst long")


_AVAILABLE = "least(50, s.v + e.t - s.t)"


@query("select dst, s.v as available, s.n as sent from (select dst, list_reduce(list_prepend({'v': 0::BIGINT, 'n': 0::BIGINT, 't': l[1].t}, l), lambda s, e: " + f"case when {_AVAILABLE} >= e.v then {{'v': ({_AVAILABLE} - e.v)::BIGINT, 'n': s.n + 1, 't': e.t}} else {{'v': {_AVAILABLE}::BIGINT, 'n': s.n, 't': e.t}} end) as s from (with {_CALLS} select dst, list({{'v': bytes, 'n': 0::BIGINT, 't': floor(epoch(ts))::BIGINT // 2000}} order by ts, event_id) as l from calls group by dst))")
def lookup_budget(spark, sf):
    """What each host may still send of a budget of one byte a tick of 2,000 seconds, 50 at most."""
    s = _calls(spark, sf).select("dst", "ts", "event_id", "bytes", F.floor(F.unix_timestamp("ts") / 2000).alias("at"))
    return measures.budgeted(s, ["dst"], ["ts", "event_id"], "at", "bytes", 1, 50, "dst long")


_STATUS = " ".join(f"when {code} then '{name}'" for code, name in measures.STATUS.items())


@query(f"select case l_orderkey % 25 {_STATUS} else 'unknown' end as status, count(*)::BIGINT as n from lineitem group by 1")
def status_names(spark, sf):
    code = d.table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 25).alias("code")).agg(F.count("*").alias("n"))
    return code.groupBy(measures.status_name(F.col("code")).alias("status")).agg(F.sum("n").alias("n"))


@query(f"with {d.NODES} select id, case when vnode = 0 then k else k * 7 + k end::BIGINT as age, greatest(case when vnode = 0 then k * 11 else 0 end, 30)::BIGINT as known from nodes")
def node_ages(spark, sf):
    k = F.col("k")
    age, known = measures.ages(k * 7, k, F.col("vnode") == 0, k * 11)
    return d.nodes(spark, sf).select("id", age.cast("long").alias("age"), known.cast("long").alias("known"))


_TURN = "(('0x' || substr(id, 1, 4))::BIGINT / 65535.0::DOUBLE * 2.0::DOUBLE * pi())"
_PLACES = d.LIVING + f", places as (select id, trunc(300 + sin({_TURN}) * 270.0::DOUBLE)::INT as x, trunc(300 - cos({_TURN}) * 270.0::DOUBLE)::INT as y from living)"


@query(f"with {_PLACES} select id, x, y from places")
def ring_places(spark, sf):
    x, y = ids.place("id", 600)
    return d.living(spark, sf).select("id", x.alias("x"), y.alias("y"))


@query(f"with {_PLACES}, clicks as (select a * 100 as px, b * 100 as py from (select unnest(range(7)) as a), (select unnest(range(7)) as b)) select px, py, arg_min(id, ((px - x) ** 2 + (py - y) ** 2, id)) as id from clicks, places group by px, py")
def place_to_node(spark, sf):
    """The drawn node that is nearest to each of 49 points of the picture, the lowest id of several."""
    off = (F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y"))
    clicks = spark.range(49).select((F.floor(F.col("id") / 7) * 100).alias("px"), (F.col("id") % 7 * 100).alias("py"))
    # each pixel's lowest id first: the circle has as many pixels, however many nodes are drawn
    pixels = ring_places(spark, sf).groupBy("x", "y").agg(F.min("id").alias("id"))
    at = pixels.crossJoin(F.broadcast(clicks))  # 49 rows
    return at.groupBy("px", "py").agg(F.min_by("id", F.struct(off, "id")).alias("id"))


@query(f"""with {_LEVELS}, l as (select depth, count(*) filter (n > 64) as inner_, count(*) as n_some, sum(case when n <= 64 then n else 0 end) as keys from shape where n > 0 or depth = 0 group by depth),
t as (select a.depth, a.inner_, a.n_some, a.keys, coalesce(b.inner_ * 64, a.n_some) as nodes from l a left join l b on b.depth = a.depth - 1), u as (select *, nodes - inner_ as leaves, nodes - n_some as empty from t)
select (min(depth) filter (leaves > 0))::INT as least, (max(depth) filter (leaves > 0))::INT as most, round(sum(depth * leaves) / sum(leaves)::DOUBLE, 6) as mean, round(sum(keys) / sum(nodes)::DOUBLE, 6) as per_node,
 round(sum(keys) / sum(leaves)::DOUBLE, 6) as per_leaf, round(sum(keys) / nullif(sum(leaves) - sum(empty), 0)::DOUBLE, 6) as per_used_leaf, round(sum(keys) / nullif(sum(inner_), 0)::DOUBLE, 6) as per_inner from u""")
def merkle_depths(spark, sf):
    out = merkle.depths(d.item_keys(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("least", "most")})
