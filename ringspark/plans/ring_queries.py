"""Queries on ids and on the ring, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringspark.functions import ids
from ringspark.operators import ring
from ringspark.plans import derived as d

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


@query(f'with {d.OWNED} select "key", owner from owned')
def key_owner(spark, sf):
    return ring.owners(d.keys(spark, sf), d.living(spark, sf)).select("key", "owner")


@query(f'with {d.OWNED} select "key", owner_pred from owned')
def key_predecessor(spark, sf):
    return ring.owners(d.keys(spark, sf), d.living(spark, sf)).select("key", "owner_pred")


@query(f'with {d.OWNED} select owner, count(*)::BIGINT as n_keys, sum(size)::BIGINT as bytes from owned group by owner')
def owner_load(spark, sf):
    owned = ring.owners(d.keys(spark, sf), d.living(spark, sf))
    return owned.groupBy("owner").agg(F.count("*").alias("n_keys"), F.sum("size").alias("bytes"))


@query(f"""with {d.NODES}, {d.ITEMS}, live as (select * from nodes where alive and k % 5 <> 0)
select (substr(id, 1, 2)) as part, owner, count(*)::BIGINT as n from (select i.id, coalesce((select min(id) from live where id >= i.id), (select min(id) from live)) as owner from items i) group by 1, 2""")
def owner_without_failed(spark, sf):
    """Owners where a set of failed nodes is left out: an anti-join before the lookup."""
    failed = d.nodes(spark, sf).where("k % 5 = 0").select("id")
    alive = d.living(spark, sf).join(failed, "id", "left_anti")
    owned = ring.owners(d.item_keys(spark, sf), alive, "id")
    return owned.groupBy(F.substring("id", 1, 2).alias("part"), "owner").agg(F.count("*").alias("n"))


_TRIPLES = """triples as (select sha1(item_id::VARCHAR) as a, case when item_id % 4 = 0 then sha1(item_id::VARCHAR) else sha1(text) end as b, n.id as n from benchmark,
 (select sha1(l_orderkey::VARCHAR) as id from (select distinct l_orderkey from lineitem)
  union select sha1(item_id::VARCHAR) from benchmark) n)"""


@query(f"""with {_TRIPLES} select a, b, {", ".join(f"sum({d.sql_between(k, 'a', 'b', 'n')}::INT)::BIGINT as n_{k}" for k in ("open", "left", "right", "both"))} from triples group by a, b""")
def interval_predicates(spark, sf):
    b = d.table(spark, sf, "benchmark")
    own = F.sha1(F.col("item_id").cast("string").cast("binary"))
    ranges = b.select(own.alias("a"), F.when(F.col("item_id") % 4 == 0, own).otherwise(ids.hash_id("text")).alias("b"))
    points = d.table(spark, sf, "lineitem").select(F.sha1(F.col("l_orderkey").cast("string").cast("binary")).alias("n")).distinct()
    points = points.union(b.select(own.alias("n"))).distinct()
    return ring.range_counts(points, ranges)


@query(f"with i as (select sha1(text) as id from benchmark union select repeat('f', 40) union select repeat('0', 40) union select '00000000ffffffff' || repeat('f', 24)) select id, {d.sql_add('id', "repeat('0', 39) || '1'").replace("substr(repeat('0', 39) || '1'", "substr(repeat('0', 39) || '1'")} as inc, {d.sql_subtract('id', "(repeat('0', 39) || '1')")} as dec from i")
def id_inc_dec(spark, sf):
    odd = spark.range(1).select(F.explode(F.array(F.lit(ids.TOP), F.lit(ids.ZERO), F.lit("0" * 8 + "f" * 32))).alias("id"))
    all_ = d.table(spark, sf, "benchmark").select(ids.hash_id("text").alias("id")).union(odd).distinct()
    return all_.select("id", ids.increment("id").alias("inc"), ids.decrement("id").alias("dec"))


@query(f"with {d.LIVING}, s as (select id, p, {d.sql_power('p')} as pw from living, (select unnest(range(160))::BIGINT as p) r) select id, p::INT as p, {d.sql_add('id', 'pw')} as after, {d.sql_subtract('id', 'pw')} as before from s")
def finger_starts(spark, sf):
    return ring.power_steps(d.living(spark, sf))


@query(f"with {d.OWNED} select \"key\", {d.sql_distance('\"key\"', 'owner')} as gap, {d.sql_distance('\"key\"', '\"key\"')} as whole from owned")
def ring_distance(spark, sf):
    return ring.owners(d.keys(spark, sf), d.living(spark, sf)).select("key", ids.distance("key", "owner").alias("gap"), ids.distance("key", "key").alias("whole"))


def _sql_slot(x: str, k: int) -> str:
    h = f"('0x' || substr({x}, {1 + 3 * (k // 2)}, 3))::INT"
    return f"({h} & 63)" if k % 2 else h if k == 26 else f"({h} >> 6)"


@query(f"with {d.KEYS} select \"key\", {', '.join(f'{_sql_slot('\"key\"', k)}::INT as s{k}' for k in (0, 1, 2, 3, 24, 25, 26))} from keys")
def merkle_slots(spark, sf):
    return d.keys(spark, sf).select("key", *(ids.slot("key", k).alias(f"s{k}") for k in (0, 1, 2, 3, 24, 25, 26)))


@query(f"""with {d.KEYS}, k as (select "key", {d.limb('"key"', 0)} as hi, {d.limb('"key"', 4)} as lo from keys)
select "key", (hi >> 27)::BIGINT as top5, bit_count(lo)::INT as ones, (case when lo > 0 then length(bin(lo)) - 1 else 0 end)::INT as log_low,
 substr("key", 9, 32) || '00000000' as dropped32, substr("key", 1, 32) || '00000000' as db_key, substr("key", 1, 32) || printf('%08x', size) as aux_key,
 round(('0x' || substr("key", 1, 4))::BIGINT::DOUBLE / 65535.0::DOUBLE * 2.0::DOUBLE * pi(), 9) as angle from k join keys using ("key")""")
def id_parts(spark, sf):
    return d.keys(spark, sf).select(
        "key", ids.top_bits("key", 5).alias("top5"), ids.low_ones("key").alias("ones"), ids.log2_floor(ids.limbs("key")[-1]).alias("log_low"),
        ids.drop_top_bits("key", 32).alias("dropped32"), ids.database_key("key").alias("db_key"), ids.with_aux("key", "size").alias("aux_key"), F.round(ids.angle("key"), 9).alias("angle"),
    )


@query("""with t as (select user_id, case user_id % 4 when 0 then upper(substr(sha1(user_id::VARCHAR), 1, 12)) when 1 then sha1(user_id::VARCHAR) || 'a' when 2 then 'xyz' else '' end as s from (select distinct user_id from events))
select user_id, s, case when regexp_full_match(s, '[0-9a-fA-F]{0,40}') then lpad(lower(s), 40, '0') end as id from t""")
def id_parse(spark, sf):
    u = d.table(spark, sf, "events").select("user_id").distinct()
    sha = F.sha1(F.col("user_id").cast("string").cast("binary"))
    s = F.when(F.col("user_id") % 4 == 0, F.upper(F.substring(sha, 1, 12))).when(F.col("user_id") % 4 == 1, F.concat(sha, F.lit("a"))).when(F.col("user_id") % 4 == 2, "xyz").otherwise("")
    return u.select("user_id", s.alias("s")).withColumn("id", ids.parse("s"))


@query(f"with {d.NODES} select id, (k % 3 <> 0 and port between 0 and 65535) as authentic from (select case when k % 3 = 0 then sha1('x' || id) else id end as id, k, port from nodes)")
def node_identity(spark, sf):
    n = d.nodes(spark, sf).withColumn("id", F.when(F.col("k") % 3 == 0, F.sha1(F.concat(F.lit("x"), "id").cast("binary"))).otherwise(F.col("id")))
    return n.select("id", ids.is_authentic("id", "host", "port", "vnode").alias("authentic"))


@query(f"""with r as (select item_id, sha1(item_id::VARCHAR) as l, sha1(text) as h from benchmark)
select a.item_id as a, b.item_id as b, ({d.sql_between('both', 'a.l', 'a.h', 'b.l')} or {d.sql_between('both', 'a.l', 'a.h', 'b.h')} or {d.sql_between('both', 'b.l', 'b.h', 'a.l')} or {d.sql_between('both', 'b.l', 'b.h', 'a.h')}) as meets
from r a join r b on b.item_id = a.item_id + 1""")
def range_overlap(spark, sf):
    r = d.table(spark, sf, "benchmark").select("item_id", F.sha1(F.col("item_id").cast("string").cast("binary")).alias("l"), ids.hash_id("text").alias("h"))
    s = r.select(F.col("item_id").alias("b"), (F.col("item_id") - 1).alias("a"), F.col("l").alias("l2"), F.col("h").alias("h2"))
    return r.withColumnRenamed("item_id", "a").join(s, "a").select("a", "b", ids.overlap(("l", "h"), ("l2", "h2")).alias("meets"))


@query("""with w as (select item_id, hex(encode(text)) as h from benchmark), p as (select item_id, h, unnest(range(greatest(length(h) // 8, 1))) as i from w)
select item_id, coalesce(bit_xor(('0x' || substr(h, (8 * i + 7)::INT, 2) || substr(h, (8 * i + 5)::INT, 2) || substr(h, (8 * i + 3)::INT, 2) || substr(h, (8 * i + 1)::INT, 2))::BIGINT) filter (length(h) >= 8), 0)::BIGINT as x from p group by item_id""")
def word_xor(spark, sf):
    return d.table(spark, sf, "benchmark").select("item_id", ids.word_xor("text").alias("x"))


@query("""with t as (select distinct user_id % 8 as u from events), s as (select u, ['90s', '5m', '2h', '1d', '3w', '6M', '1y', '7q'][u + 1] as life, ['10b', '3K', '2M', '1G', '5', 'x', '0b', '7k'][u + 1] as size from t)
select u, life, size, [90, 300, 7200, 86400, 1814400, 15552000, 31557600, null][u + 1]::BIGINT as seconds, [10, 3072, 2097152, 1073741824, 5368709120, null, 0, null][u + 1]::BIGINT as bytes from s""")
def suffix_parse(spark, sf):
    u = d.table(spark, sf, "events").select((F.col("user_id") % 8).alias("u")).distinct()
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("u") + 1).cast("int"))
    u = u.select("u", pick("90s", "5m", "2h", "1d", "3w", "6M", "1y", "7q").alias("life"), pick("10b", "3K", "2M", "1G", "5", "x", "0b", "7k").alias("size"))
    return u.select("u", "life", "size", ids.seconds("life").alias("seconds"), ids.size_bytes("size").alias("bytes"))


@query(f'with {d.REPLICAS} select "key", replica, node, host, owner from replicas')
def replica_placement(spark, sf):
    return ring.replicas(d.keys(spark, sf), d.living(spark, sf), 6, 3).select("key", "replica", "node", "host", "owner")


@query(f"with {d.RANKED} select a.id, p::INT as position, b.id as neighbour from ranked a, (select unnest(range(1, 17)) as p) r, ranked b where p < a.n and b.rank = (a.rank + p) % a.n")
def successor_list(spark, sf):
    return ring.successors(d.living(spark, sf), 16)


@query(f"with {d.RANKED} select a.id, p::INT as position, b.id as neighbour from ranked a, (select unnest(range(1, 17)) as p) r, ranked b where p < a.n and b.rank = (a.rank + a.n - p) % a.n")
def predecessor_list(spark, sf):
    return ring.successors(d.living(spark, sf), 16, -1)


_AROUND = d.RANKED + ", around as (select a.id, b.id as pred, c.id as succ from ranked a join ranked b on b.rank = (a.rank + a.n - 1) % a.n join ranked c on c.rank = (a.rank + 1) % a.n)"


@query(f"with {_AROUND} select * from around")
def ring_neighbors(spark, sf):
    return ring.neighbours(d.living(spark, sf))


@query(f"with {_AROUND}, g as (select id, succ, {d.sql_distance('id', 'succ')} as gap from around) select * from g order by gap desc limit 5")
def ring_gap_max(spark, sf):
    return ring.widest_gaps(d.living(spark, sf)).orderBy(F.desc("gap")).limit(5)  # a top-k report


@query(f"with {d.RANKED}, pins as (select id, rank, n from ranked where rank % 10 = 0) select distinct b.id from pins a, (select unnest([0, 1, 2, 3, -1]) as p) r, ranked b where b.rank = (a.rank + a.n + p) % a.n")
def pinned_nodes(spark, sf):
    n = d.living(spark, sf)
    return ring.pinned(n, ring.ranked(n.select("id")).where("rank % 10 = 0"), 3, 1)


_FINGERS = d.LIVING + f", starts as (select id, p, {d.sql_add('id', 'pw')} as start from (select id, p, {d.sql_power('p')} as pw from living, (select unnest(range(160))::BIGINT as p) r)), fingers as (select id, p::INT as i, start, coalesce((select min(l.id) from living l where l.id >= start), (select min(id) from living)) as finger from starts)"


@query(f"with {_FINGERS} select id, finger, min(i)::INT as i from fingers where finger <> id group by id, finger")
def finger_table(spark, sf):
    return ring.distinct_fingers(d.living(spark, sf))


@query(f"with {d.RANKED} select a.id, round(1461501637330902918203684832716283019655932542976.0::DOUBLE * 8 / s / 1e0, 3) as estimate from (select a.id, {' + '.join(f'{d.limb("x", i)}::DOUBLE * {float(1 << 32 * (4 - i))!r}::DOUBLE' for i in range(5))} as s from (select a.id, {d.sql_subtract('b.id', 'a.id')} as x from ranked a join ranked b on b.rank = (a.rank + 8) % a.n) a) a")
def ring_size_estimate(spark, sf):
    return ring.size_estimate(d.living(spark, sf), 8).withColumn("estimate", F.round("estimate", 3))


_CLAIMS = _AROUND + ", claims as (select row_number() over (order by id) - 1 as r, id, pred, succ from around), told as (select id, case when r % 5 = 0 then id else succ end as succ, case when r % 7 = 0 then id else pred end as pred from claims)"


@query(f"with {_CLAIMS} select t.id, t.succ = a.succ as succ_ok, t.pred = a.pred as pred_ok, (t.succ = a.succ and t.pred = a.pred) as stable from told t join around a using (id)")
def ring_validate(spark, sf):
    """What nodes say of their neighbours (some wrong) against what the sorted ids say."""
    true = ring.neighbours(d.living(spark, sf))
    r = ring.ranked(true)
    told = r.select("id", F.when(F.col("rank") % 5 == 0, F.col("id")).otherwise(F.col("succ")).alias("t_succ"), F.when(F.col("rank") % 7 == 0, F.col("id")).otherwise(F.col("pred")).alias("t_pred"))
    both = told.join(true, "id").select("id", (F.col("t_succ") == F.col("succ")).alias("succ_ok"), (F.col("t_pred") == F.col("pred")).alias("pred_ok"))
    return both.withColumn("stable", F.col("succ_ok") & F.col("pred_ok"))


@query(f"with {d.OWNED}, src as (select min(id) as src from living) select src, \"key\", owner from owned, src")
def route_owner(spark, sf):
    """Where lookups from one node end: at the owners."""
    looked = d.keys(spark, sf).join(F.broadcast(d.living(spark, sf).agg(F.min("id").alias("src"))))
    return ring.routes(looked.select("src", "key"), d.living(spark, sf).select("id")).select("src", "key", "owner")


#: A lookup for each key, from the owner of the key's own hash; at each node the furthest of its fingers and four successors before the key is next.
ROUTES = "recursive " + _AROUND + f""", starts as (select id, p, {d.sql_add('id', 'pw')} as start from (select id, p, {d.sql_power('p')} as pw from living, (select unnest(range(160))::BIGINT as p) r)),
known as (select distinct id, coalesce((select min(l.id) from living l where l.id >= start), (select min(id) from living)) as nb from starts union select a.id, b.id from ranked a, (select unnest(range(1, 5)) as p) r, ranked b where p < a.n and b.rank = (a.rank + p) % a.n),
{d.KEYS}, asked as (select coalesce((select min(id) from living where id >= sha1("key")), (select min(id) from living)) as src, "key" from keys),
steps as (select src, "key", src as cur, src as path, false as done from asked
 union all select src, "key", nxt as cur, path || ',' || nxt, ends from (select s.src, s."key", s.path, {d.sql_between('right', 's.cur', 'a.succ', 's."key"')} as ends,
  case when {d.sql_between('right', 's.cur', 'a.succ', 's."key"')} then a.succ else arg_max(k.nb, (k.nb < s.cur, k.nb)) filter ({d.sql_between('open', 's.cur', 's."key"', 'k.nb')}) end as nxt
  from steps s join around a on a.id = s.cur join known k on k.id = s.cur where not s.done group by s.src, s."key", s.path, s.cur, a.succ)),
routes as (select src, "key", path, cur as owner, (length(path) - length(replace(path, ',', '')))::BIGINT as hops from steps where done)"""


def lookups(spark, sf):
    keys = d.keys(spark, sf).select("key").withColumn("start", F.sha1(F.col("key").cast("binary")))
    return ring.routes(ring.owners(keys, d.living(spark, sf), "start").select(F.col("owner").alias("src"), "key"), d.living(spark, sf).select("id"))


@query(f'with {ROUTES} select src, "key", path, owner, hops from routes')
def route_hops(spark, sf):
    """Paths and hops of a lookup for each key."""
    return lookups(spark, sf).withColumn("path", F.array_join("path", ","))


@query()
def nearest_finger(spark, sf):
    return ring.nearest_fingers(d.coordinates(spark, sf))
