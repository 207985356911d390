"""Queries on replicas and repairs, on calls, latencies and coordinates, and on streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringspark.functions import ids
from ringspark.operators import measures, repair, ring
from ringspark.plans import derived as d
from ringspark.plans import ring_queries
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


@query(f'with {d.REPLICAS} select "key", count(distinct node)::BIGINT as copies, count(distinct host)::BIGINT as hosts from holdings group by "key"')
def replica_counts(spark, sf):
    return repair.replica_counts(d.holdings(spark, sf))


@query(f'with {d.REPLICAS}, c as (select "key", count(distinct node)::BIGINT as copies from holdings group by "key") select k."key", coalesce(copies, 0)::BIGINT as copies from keys k left join c using ("key") where coalesce(copies, 0) < 2')
def under_replicated(spark, sf):
    found = d.keys(spark, sf).select("key").join(repair.replica_counts(d.holdings(spark, sf)), "key", "left")
    return found.select("key", F.coalesce("copies", F.lit(0)).cast("long").alias("copies")).where("copies < 2")


_AROUND = ", around as (select a.id as owner, p as position, b.id as node from ranked a, (select unnest(range(6)) as p) r, ranked b where p < a.n and b.rank = (a.rank + p) % a.n)"


@query(f"""with {d.REPLICAS}{_AROUND}, h as (select distinct "key", node from holdings),
slots as (select o."key", o.owner, a.position, a.node, h.node is not null as held from owned o join around a using (owner) left join h on h."key" = o."key" and h.node = a.node)
select owner, "key", count(*) filter (held)::BIGINT as copies, min_by(node, position) filter (not held) as dst from slots group by owner, "key" having count(*) filter (held) < 3 and count(*) filter (not held) > 0""")
def prefix_repairs(spark, sf):
    return repair.prefix_repairs(d.holdings(spark, sf), d.keys(spark, sf), d.living(spark, sf), 6, 3)


@query(f"""with {d.REPLICAS}, h as (select distinct "key", node from holdings),
near as (select a.id, s.side, min_by(b.id, case when s.side = 0 then (b.rank + a.n - a.rank) % a.n else (a.rank + a.n - b.rank) % a.n end) as src from ranked a, (select unnest([0, 1]) as side) s, ranked b
 where b.host <> a.host group by 1, 2),
low as (select a.id, b.id as low from ranked a join ranked b on b.rank = (a.rank + a.n - 3) % a.n),
offers as (select n.id as node, h."key", n.side, n.src from near n join low l on l.id = n.id join h on h.node = n.src where {d.sql_between('right', 'l.low', 'n.id', 'h."key"')})
select node, "key", min_by(src, side) as src from offers o where not exists (select 1 from h where h.node = o.node and h."key" = o."key") group by 1, 2""")
def neighbour_repairs(spark, sf):
    return repair.neighbour_repairs(d.holdings(spark, sf), d.living(spark, sf), 3)


@query(f"""with {d.REPLICAS}, h as (select distinct "key", node from holdings), near as (select a.id as dst, b.id as node from ranked a, (select unnest(range(1, 3)) as p) r, ranked b where b.rank = (a.rank + p) % a.n)
select h.node, h."key", o.owner as dst from h join owned o using ("key") where h.node <> o.owner and not exists (select 1 from near n where n.dst = o.owner and n.node = h.node) and not exists (select 1 from h g where g.node = o.owner and g."key" = h."key")""")
def misplaced_keys(spark, sf):
    return repair.misplaced(d.holdings(spark, sf), d.living(spark, sf), 2)


@query(f"""with {d.REPLICAS}, h as (select distinct "key", node from holdings), scope as (select a.id as owner, b.id as node from ranked a, (select unnest(range(2)) as p) r, ranked b where b.rank = (a.rank + p) % a.n),
p as (select s.node, o."key", h.node is null as gone, case when o."key" > s.node then 0 else 1 end as far from owned o join scope s using (owner) left join h on h.node = s.node and h."key" = o."key"),
m as (select *, gone and not coalesce(lag(gone) over w, false) as starts, row_number() over w = 1 as first, row_number() over (partition by node order by far desc, "key" desc) = 1 as last from p window w as (partition by node order by far, "key"))
select node, count(*)::BIGINT as in_scope, count(*) filter (gone)::BIGINT as missing, count(*) filter (starts)::BIGINT as runs, bool_or(gone and first) as at_start, bool_or(gone and last) as at_end from m group by node""")
def missing_key_report(spark, sf):
    return repair.missing_report(d.holdings(spark, sf), d.keys(spark, sf), d.living(spark, sf))


@query(f'with {d.REPLICAS}, o as (select node as dst, "key", count(*)::BIGINT as asked from holdings group by 1, 2) select * from o qualify row_number() over (partition by dst order by "key") <= 16')
def repair_queue(spark, sf):
    return repair.queue(d.holdings(spark, sf).select(F.col("node").alias("dst"), "key"), 16)


@query(f'with {d.REPLICAS} select count(*)::BIGINT as total, count(distinct "key")::BIGINT as keys from holdings')
def key_totals(spark, sf):
    return d.holdings(spark, sf).agg(F.count("*").alias("total"), F.count_distinct("key").alias("keys"))


_DIST = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) + a.ht + b.ht"


@query(f"with {d.COORDINATES}, p as (select a.id, b.id as other, round({_DIST}, 4) as distance from places a join places b on a.id <> b.id) select id, other, distance from p qualify row_number() over (partition by id order by distance, other) <= 3")
def coordinate_topk(spark, sf):
    """The three nearest nodes of each node by coordinates."""
    return ring.nearest_places(d.coordinates(spark, sf), 3)


_REPLICA_RANK = d.REPLICAS + ", places as (" + d.COORDINATES.partition("places as (")[2]


@query(f"with {_REPLICA_RANK}, p as (select r.\"key\", r.node, round({_DIST}, 4) as distance from replicas r join places a on a.id = r.owner join places b on b.id = r.node) select \"key\", node, distance, row_number() over (partition by \"key\" order by distance, node)::INT as choice from p")
def latency_rank(spark, sf):
    """In which order a reader at the owner would ask the replicas of each key."""
    from pyspark.sql import Window

    r = ring.replicas(d.keys(spark, sf), d.living(spark, sf), 6, 3)
    c = d.coordinates(spark, sf)
    a = c.select(F.col("id").alias("owner"), F.struct("x", "y", "ht").alias("a"))
    b = c.select(F.col("id").alias("node"), F.struct("x", "y", "ht").alias("b"))
    p = r.join(a, "owner").join(b, "node").select("key", "node", F.round(ring.coordinate_distance(F.col("a"), F.col("b")), 4).alias("distance"))
    return p.withColumn("choice", F.row_number().over(Window.partitionBy("key").orderBy("distance", "node")))


def _calls(spark, sf):
    kind = F.when(F.col("event_id") % 10 == 0, "resend").when(F.col("event_id") % 3 == 0, "reply").otherwise("call")
    e = d.table(spark, sf, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("prog"), (F.col("user_id") % 3).alias("proc"), F.col("user_id").alias("dst"), kind.alias("kind"), F.length("props").cast("long").alias("bytes"), F.floor(F.col("value") * 1000).cast("long").alias("latency"))


_CALLS = "calls as (select event_id, ts, event_type as prog, user_id % 3 as proc, user_id as dst, case when event_id % 10 = 0 then 'resend' when event_id % 3 = 0 then 'reply' else 'call' end as kind, length(props)::BIGINT as bytes, floor(value * 1000)::BIGINT as latency from events)"


@query(f"with {_CALLS} select prog, proc, count(*) filter (kind = 'call')::BIGINT as calls, sum(bytes)::BIGINT as bytes, count(*) filter (kind = 'resend')::BIGINT as resent, count(*) filter (kind = 'reply')::BIGINT as replies from calls group by prog, proc")
def rpc_stats(spark, sf):
    return measures.call_stats(_calls(spark, sf))


@query(f"with {_CALLS} select dst, count(*)::BIGINT as n, round(avg(latency), 3) as mean, round(var_pop(latency), 1) as variance, max(latency) as top, sum(bytes)::BIGINT as bytes from calls group by dst")
def host_latency(spark, sf):
    return measures.host_latency(_calls(spark, sf)).withColumns({"mean": F.round("mean", 3), "variance": F.round("variance", 1)})


@query(f"with {_CALLS}, r as (select *, row_number() over (partition by dst order by ts desc, event_id desc) - 1 as age, count(*) over (partition by dst) as n from calls) select dst, n, round(sum(latency * power(0.8::DOUBLE, age) * case when age = n - 1 then 1 else 0.2::DOUBLE end), 3) as smoothed from r group by dst, n")
def latency_smoothed(spark, sf):
    return measures.smoothed(_calls(spark, sf), ["dst"], ["ts", "event_id"], "latency", 0.2).withColumn("smoothed", F.round("smoothed", 3))


@query(f"with {_CALLS}, l as (select dst, list(latency order by ts, event_id) as l from calls group by dst) select dst, len(l)::BIGINT as n, list_reduce(l, lambda a, b: (9 * a + b) // 10)::BIGINT as smoothed from l")
def latency_ewma(spark, sf):
    return measures.integer_smoothed(_calls(spark, sf).select("dst", "ts", "event_id", "latency"), ["dst"], ["ts", "event_id"], "latency", "dst long")


@query()
def coordinate_fit(spark, sf):
    s = _calls(spark, sf).select("dst", "ts", "event_id", "latency", (F.col("proc") * 100.0).alias("ox"), F.lit(50.0).alias("oy"), F.lit(100.0).alias("oht"), F.lit(0.5).alias("oerr"))
    return measures.relaxed(s, ["dst"], ["ts", "event_id"], "dst long")


def sql_fold(elements: str, first: str, step: str, by: str = "dst") -> str:
    """by, s: a fold over each group's elements in order of (ts, event_id); step is an expression of the state s and the element e, both of first's type."""
    return f"with {_CALLS}, l as (select {by}, list({elements} order by ts, event_id) as l from calls group by {by}) select {by}, list_reduce(list_prepend({first}, l), lambda s, e: {step}) as s from l"


_WINDOW = "(case when e.w = 1 then greatest(1.0::DOUBLE, s.w / 2) else s.w + 1 / s.w end)"


@query("select dst, round(s.w, 6) as window, round(s.m, 6) as mean from (" + sql_fold("{'w': (kind = 'resend')::INT::DOUBLE, 'm': 0.0::DOUBLE}", "{'w': 1.0::DOUBLE, 'm': 1.0::DOUBLE}", f"{{'w': {_WINDOW}, 'm': (49 * s.m + {_WINDOW}) / 50}}") + ")")
def send_window(spark, sf):
    s = _calls(spark, sf).select("dst", "ts", "event_id", (F.col("kind") == "resend").alias("lost"))
    return measures.window_control(s, ["dst"], ["ts", "event_id"], "lost", "dst long").withColumns({c: F.round(c, 6) for c in ("window", "mean")})


@query("select dst, round(s, 6) as interval from (" + sql_fold("(kind = 'resend')::INT::DOUBLE", "1000.0::DOUBLE", "least(40000.0::DOUBLE, case when e = 1 then s * 2 when s >= 20000 then s - 1000 when s < 10000 then s * 1.2::DOUBLE else s end)") + ")")
def stabilize_timer(spark, sf):
    s = _calls(spark, sf).select("dst", "ts", "event_id", (F.col("kind") == "resend").alias("outstanding"))
    return measures.timers(s, ["dst"], ["ts", "event_id"], "dst long").withColumn("interval", F.round("interval", 6))


@query(f"with {_CALLS} select event_id, case when latency <= 10000 then 'green' when latency <= 50000 then 'yellow' when latency <= 200000 then 'red' end as colour from calls")
def latency_colour(spark, sf):
    c = _calls(spark, sf)
    return c.select("event_id", measures.bucketed(c, "latency", [(10000, "green"), (50000, "yellow"), (200000, "red")]).alias("colour"))


@query(f"with {d.COORDINATES}, b as (select substr(id, 1, 1) as part, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from places group by 1) select part, round((x0 + x1) / 2, 6) as cx, round((y0 + y1) / 2, 6) as cy, round(greatest(x1 - x0, y1 - y0) * 1.3::DOUBLE, 6) as side from b")
def bounding_box(spark, sf):
    p = d.coordinates(spark, sf).withColumn("part", F.substring("id", 1, 1))
    return measures.bounding_box(p, ["part"]).select("part", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "side")))


@query(f"with {d.NODES} select id, alive from nodes where k % 3 <> 0 order by alive, k * 37 % 101, id limit 5")
def evicted_nodes(spark, sf):
    n = d.nodes(spark, sf).select("id", "alive", (F.col("k") % 3 == 0).alias("pinned"), (F.col("k") * 37 % 101).alias("used"))
    return measures.evicted(n, 5).select("id", "alive")  # five is how many are asked to go


@query("with r as (select (power(2, l_linenumber) * 1024)::BIGINT as size, (l_orderkey % 5 + 1)::BIGINT as blocks, l_quantity as ms from lineitem) select size, blocks, round(size * blocks * count(*) / (sum(ms) / 1000), 3) as rate from r group by size, blocks")
def throughput_series(spark, sf):
    r = d.table(spark, sf, "lineitem").select((F.pow(F.lit(2), "l_linenumber") * 1024).cast("long").alias("size"), (F.col("l_orderkey") % 5 + 1).alias("blocks"), F.col("l_quantity").alias("ms"))
    return measures.throughput(r).withColumn("rate", F.round("rate", 3))


@query(f"with {d.NODES}, s as (select id, k * 100 as known, vnode * 40 + k as age, k % 4 = 0 as pinned from nodes) select id, (coalesce(known::DOUBLE / nullif(known + age, 0), 0) > 1 - power(0.1::DOUBLE, 0.5::DOUBLE) or age < 60 or pinned) as fresh from s")
def fresh_nodes(spark, sf):
    n = d.nodes(spark, sf)
    return n.select("id", measures.fresh_enough(F.col("k") * 100, F.col("vnode") * 40 + F.col("k"), 2, F.col("k") % 4 == 0).alias("fresh"))


@query(f"with {ring_queries.ROUTES} select src, count(*)::BIGINT as lookups, sum(hops)::BIGINT as hops, max(hops) as most, round(avg(hops), 6) as mean from routes group by src")
def hop_stats(spark, sf):
    return measures.hop_stats(ring_queries.lookups(spark, sf)).withColumn("mean", F.round("mean", 6))


@query("select time_bucket(interval '1 hour', ts)::TIMESTAMP as start, count(*)::BIGINT as n, round(sum(value), 4) as total from events group by 1")
def stream_rate(spark, sf):
    return state.run(state.rate(state.events(spark, sf)), "complete").withColumns({"total": F.round("total", 4), "start": F.col("start").cast("timestamp_ntz")})


@query("select user_id, max(ts) as heard, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id")
def stream_newest(spark, sf):
    return state.run(state.newest(state.events(spark, sf)), "complete").withColumn("heard", F.col("heard").cast("timestamp_ntz"))


@query("select distinct user_id, event_type from events")
def stream_unique(spark, sf):
    return state.run(state.unique(state.events(spark, sf)), "append")


@query("select user_id, (floor(epoch(max(ts))) + 3600)::BIGINT as expires, count(*)::BIGINT as writes from events group by user_id")
def stream_lifetimes(spark, sf):
    return state.run(state.lifetimes(state.events(spark, sf), 3600), "complete")


@query("""with e as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as r from events), l as (select user_id, count(*) as seen, coalesce(max(r) filter (event_type <> 'error'), 0) as good from e group by user_id)
select user_id, (seen - good) <= 4 as alive, (seen - good)::BIGINT as losses, seen::BIGINT as seen from l""")
def stream_liveness(spark, sf):
    return state.run(state.liveness(state.events(spark, sf)), "update")
