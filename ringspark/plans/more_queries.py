"""More queries on ids, trees, repairs, measurements and soft state, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringspark.functions import ids
from ringspark.operators import measures, merkle, repair, ring, store, views
from ringspark.plans import derived as d
from ringspark.plans.repair_queries import _CALLS, _calls, sql_fold
from ringspark.plans.repair_queries import SQL as REPAIR_SQL
from ringspark.plans.repair_queries import Q as REPAIR_Q
from ringspark.plans.store_queries import _CHUNKS, _LEVELS, _files
from ringspark.plans.view_queries import _BITS
from ringspark.streaming import state

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


@query(f"""with {d.KEYS}, s as (select "key", substr("key", 9, 32) || repeat('0', 8) as by32 from keys) select "key", {d.sql_add('"key"', '"key"')} as by1, by32, {d.sql_add('by32', 'by32')} as by33 from s""")
def id_double(spark, sf):
    return d.keys(spark, sf).select("key", *(ids.double("key", k).alias(f"by{k}") for k in (1, 32, 33)))


_TOP = "(length(ltrim({0}, '0')) - 1)"


@query(f"""with {d.KEYS}, b as (select "key", {_BITS} as bits from keys), o as (select "key", case when ('0x' || substr("key", 1, 1))::INT % 2 = 0 then substr(bits, 1, 100) || repeat('1', 60) else repeat('0', 7) || substr(bits, 8) end as other from b),
p as (select "key", bits, other, list_filter(range(160), lambda i: substr(bits, (i + 1)::INT, 1) <> substr(other, (i + 1)::INT, 1)) as differ from b join o using ("key"))
select "key", (case when {_TOP.format('bits')} <> {_TOP.format('other')} then {_TOP.format('other')} when len(differ) = 0 then -1 else 159 - differ[1] end)::INT as bit from p""")
def id_mismatch(spark, sf):
    k = d.keys(spark, sf).withColumn("bits", ids.bits_of("key"))
    even = F.conv(F.substring("key", 1, 1), 16, 10).cast("int") % 2 == 0
    other = F.when(even, F.concat(F.substring("bits", 1, 100), F.repeat(F.lit("1"), F.lit(60)))).otherwise(F.concat(F.lit("0" * 7), F.substring("bits", 8, 153)))
    k = k.withColumn("other", other).withColumn("other", F.lower(F.concat(*(F.lpad(F.conv(F.substring("other", 1 + 32 * i, 32), 2, 16), 8, "0") for i in range(5)))))
    return k.select("key", ids.highest_mismatch("key", "other").alias("bit"))


@query(f"with {d.LIVING} select id, (select min(b.id) from living b where b.id <> a.id) as other from living a")
def any_other_node(spark, sf):
    return ring.any_other(d.living(spark, sf))


@query(f"with {_LEVELS}, t as (select depth, prefix, n + (case when prefix like '%7' then 1 else 0 end) as n, n <= 64 as is_leaf from shape where (n > 0 or depth = 0) and prefix not like '13%' or depth > 1), u as (select depth - 1 as depth, substr(prefix, 1, 2 * (depth - 1)) as prefix, sum(n) as below from t where depth > 0 group by 1, 2), f as (select depth, prefix, case when n is null then 'lost' when is_leaf and n > 64 then 'full' when not is_leaf and n <= 64 then 'small' when not is_leaf and coalesce(below, 0) <> n then 'sum' end as fault from t full join u using (depth, prefix)) select depth, prefix, fault from f where fault is not null")
def tree_violations(spark, sf):
    """The faults of a tree of which some counts are wrong and a branch lacks its node."""
    t = merkle.shape(d.item_keys(spark, sf)).where("not (prefix like '13%' and depth <= 1)")
    return merkle.violations(t.withColumn("n", F.col("n") + F.when(F.col("prefix").like("%7"), 1).otherwise(0)))


@query(f"""with {d.REPLICAS}, h as (select distinct "key", node from holdings), m as (select a.id as node, p::INT as position, b.id as mirror from ranked a, (select unnest(range(0, 3)) as p) r, ranked b where p < a.n and b.rank = (a.rank + p) % a.n)
select m.node, m.position, m.mirror, count(*)::BIGINT as n, count(*) filter (h."key" is null)::BIGINT as lost from owned o join m on m.node = o.owner left join h on h.node = m.mirror and h."key" = o."key" group by all""")
def mirror_differences(spark, sf):
    return repair.mirror_differences(d.holdings(spark, sf), d.keys(spark, sf), d.living(spark, sf), 3)


def _urgent(spark, sf):
    return REPAIR_Q["misplaced_keys"](spark, sf).select("node", "key")


def _usual(spark, sf):
    return REPAIR_Q["prefix_repairs"](spark, sf).select(F.col("owner").alias("node"), "key")


_JOBS = f'g as (select distinct node, "key" from ({REPAIR_SQL["misplaced_keys"]})), p as (select distinct owner as node, "key" from ({REPAIR_SQL["prefix_repairs"]}))'


@query(f"""with {_JOBS}, a as (select * from g qualify row_number() over (partition by node order by "key") <= 4), t as (select node, count(*) as taken from a group by 1),
b as (select p.node, p."key", coalesce(t.taken, 0) as taken, row_number() over (partition by p.node order by p."key") as place from p left join t using (node) where not exists (select 1 from a where a.node = p.node and a."key" = p."key"))
select node, "key", true as from_urgent from a union all select node, "key", false from b where place <= 8 - taken""")
def repair_mix(spark, sf):
    return repair.mixed(_urgent(spark, sf), _usual(spark, sf), 8)


@query(f"""with {_JOBS}, c as (select node, substr(node, 40, 1) || substr(max("key"), 2) as last from p where substr(node, 39, 1) < 'c' group by node), m as (select p.node, p."key", coalesce(p."key" > c.last, true) as ahead from p left join c using (node)),
w as (select *, not bool_or(ahead) over (partition by node) as wrapped from m) select node, "key", wrapped from w where ahead or wrapped qualify row_number() over (partition by node order by "key") <= 5""")
def repair_continuation(spark, sf):
    """Where each node goes on with its repairs; some have no cursor, some are at the end."""
    p = _usual(spark, sf).distinct()
    last = F.concat(F.substring("node", 40, 1), F.substring("top", 2, 39)).alias("last")
    return repair.next_batch(p, p.where("substr(node, 39, 1) < 'c'").groupBy("node").agg(F.max("key").alias("top")).select("node", last), 5)


@query(f"""with {_JOBS}, e as (select * from p), f as (select * from p where substr("key", 40, 1) <> '0' union select node, "key" from g) select node, "key", 'expected' as side from (select * from e except select * from f) union all select node, "key", 'done' from (select * from f except select * from e)""")
def repair_expectations(spark, sf):
    p = _usual(spark, sf)
    return repair.unexpected(p, p.where("substr(`key`, 40, 1) <> '0'").union(_urgent(spark, sf)))


@query(f"with {d.OBJECTS}, runs as (select i as round, 700000000 + i * 2592007 as now from (select unnest(range(0, 400)) as i)), taken as (select o.*, (select min(round) from runs where now // 60 * 60 > o.expiration) as round from objects o) select round, count(*)::BIGINT as n, sum(size)::BIGINT as bytes from (select case when expiration > 0 then round end as round, size from taken) group by round")
def expiry_rounds(spark, sf):
    return store.expiry_rounds(d.objects(spark, sf), 700_000_000, 2_592_007).groupBy("round").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("select page_id as name, octet_length(encode(html))::BIGINT as bytes, sha1(encode(html)) as digest from pages where html is not null")
def file_reassembly(spark, sf):
    """Files cut into blocks, listed in indirect and inode blocks, and read back from these."""
    files = _files(spark, sf)
    chunks = store.chunks(files, 1024)
    data = files.select("name", "data", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.octet_length("data") / 1024)).cast("int") - 1)).alias("pos")).select(F.substring(F.col("data"), F.col("pos") * 1024 + 1, F.lit(1024)).alias("data"))
    back = views.reassembled(views.listing(chunks, 8), data.select(F.sha1("data").alias("id"), "data"))
    return back.select("name", F.octet_length("content").cast("long").alias("bytes"), F.sha1("content").alias("digest"))


_DEVIATION = "{'n': s.n + 1, 'm': s.m + 0.2::DOUBLE * (e.m - s.m), 'd': s.d + 0.2::DOUBLE * (abs(e.m - s.m) - s.d), 't': greatest(s.t, e.m)}"


@query(f"with {_CALLS}, l as (select dst, list({{'n': 1::DOUBLE, 'm': latency::DOUBLE, 'd': 0.0::DOUBLE, 't': latency::DOUBLE}} order by ts, event_id) as l from calls group by dst), r as (select dst, list_reduce(l, lambda s, e: {_DEVIATION}) as s from l) select dst, s.n::BIGINT as n, round(s.m, 4) as mean, round(s.d, 4) as deviation, s.t as top from r")
def latency_deviation(spark, sf):
    out = measures.deviations(_calls(spark, sf).select("dst", "ts", "event_id", "latency"), ["dst"], ["ts", "event_id"], "latency", 0.2, "dst long")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "deviation")})


_OFF = "abs(e.m - 50000.0::DOUBLE * (1 + e.d))"
_ERRORS = f"case when e.m <= 0 then s else {{'m': (49 * s.m + {_OFF}) / 50, 'd': (49 * s.d + {_OFF} / e.m) / 50, 't': s.t + 0.2::DOUBLE * ({_OFF} - s.t)}} end"


@query("select dst, round(s.m, 4) as error, round(s.d, 6) as relative, round(s.t, 4) as deviation from (" + sql_fold("{'m': latency::DOUBLE, 'd': proc::DOUBLE, 't': 0.0::DOUBLE}", "{'m': 0.0::DOUBLE, 'd': 0.0::DOUBLE, 't': 0.0::DOUBLE}", _ERRORS) + ")")
def prediction_errors(spark, sf):
    s = _calls(spark, sf).select("dst", "ts", "event_id", "latency", (F.lit(50000.0) * (1 + F.col("proc"))).alias("predicted"))
    out = measures.prediction_errors(s, ["dst"], ["ts", "event_id"], "latency", "predicted", 0.2, "dst long")
    return out.withColumns({"error": F.round("error", 4), "relative": F.round("relative", 6), "deviation": F.round("deviation", 4)})


_BACKOFF = "least(16000, case when e % 2 = 1 then s * 2 when e >= 2 and s <= 16000 then s * 12 // 10 when s > 8000 then s - 1000 else s end)"


@query("select dst, s::BIGINT as interval from (" + sql_fold("((kind = 'resend')::INT + 2 * (event_id % 4 <> 0)::INT)::BIGINT", "1000::BIGINT", _BACKOFF) + ")")
def backoff_timer(spark, sf):
    s = _calls(spark, sf).select("dst", "ts", "event_id", (F.col("kind") == "resend").alias("outstanding"), (F.col("event_id") % 4 != 0).alias("stable"))
    return measures.backoff(s, ["dst"], ["ts", "event_id"], "dst long")


@query(f"with {d.NODES}, a as (select id, k * 4001 as since, least(k * 4001, 2592000) as age from nodes where not alive) select id, since, len(list_filter(list_concat([60, 180, 420], list_transform(range(0, 2800), lambda i: 900 + 960 * i)), lambda x: x <= age))::BIGINT as probes from a")
def dead_node_probes(spark, sf):
    n = d.nodes(spark, sf).where("not alive").select("id", (F.col("k") * 4001).alias("since"))
    return n.withColumn("probes", measures.probes(F.col("since")))


@query("""with g as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) >= interval '1200 seconds' as begins from events), r as (select user_id, ts, count(*) filter (begins) over (partition by user_id order by ts) as run from g)
select user_id, min(ts)::TIMESTAMP as start, (max(ts) + interval '1200 seconds')::TIMESTAMP as stop, count(*)::BIGINT as n from r group by user_id, run""")
def stream_sessions(spark, sf):
    return state.run(state.sessions(state.events(spark, sf)), "complete").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


@query(f"with {_CALLS} select prog, bytes, part from (select prog, sum(bytes)::BIGINT as bytes, 'first' as part from calls where event_id % 2 = 0 group by prog union all select prog, sum(bytes)::BIGINT, 'second' from calls where event_id % 2 = 1 group by prog)")
def stats_appended(spark, sf):
    """Two tables of counters one after the other, in order of their key; rows may repeat."""
    part = lambda k, name: views.summed_stats(_calls(spark, sf).where(F.col("event_id") % 2 == k), "prog", ["bytes"]).withColumn("part", F.lit(name))
    return part(0, "first").unionByName(part(1, "second")).orderBy("prog", "part")
