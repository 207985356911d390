"""Queries on the keyed store, on blocks and files, and on hash summaries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringspark.functions import ids
from ringspark.operators import erasure, merkle, store
from ringspark.plans import derived as d

Q: dict = {}
SQL: dict[str, str] = {}
NOW = 800_000_000  # a moment within the orders' expirations


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


_FIRST = d.OBJECTS + ", stored as (select * from objects qualify row_number() over (partition by ns, id order by seq) = 1)"


@query(f"with {_FIRST} select * from stored")
def store_first_writer(spark, sf):
    return store.put_first(None, d.objects(spark, sf))


@query(f"with {d.OBJECTS}, a as (select * from objects where seq % 2 = 0 qualify row_number() over (partition by ns, id order by seq) = 1), b as (select * from objects where seq % 2 = 1 qualify row_number() over (partition by ns, id order by seq) = 1) select * from a union all select * from b where not exists (select 1 from a where a.ns = b.ns and a.id = b.id)")
def store_two_batches(spark, sf):
    o = d.objects(spark, sf)
    return store.put_first(store.put_first(None, o.where("seq % 2 = 0")), o.where("seq % 2 = 1"))


@query(f"with {_FIRST}, w as (select 'F' as ns, sha1(i::VARCHAR) as id from (select unnest(range(0, 1200, 7)) as i) r) select w.ns, w.id, s.size, s.expiration, s.seq, case when s.seq is null then 'NOTFOUND' else 'OK' end as status from w left join stored s using (ns, id)")
def fetch_join(spark, sf):
    wanted = spark.range(0, 1200, 7).select(F.lit("F").alias("ns"), F.sha1(F.col("id").cast("string").cast("binary")).alias("id"))
    return store.get(store.put_first(None, d.objects(spark, sf)), wanted)


@query(f"with {d.ITEMS}, k as (select sha1(text) as \"key\" from benchmark) select \"key\", coalesce((select min(id) from items where id >= \"key\"), (select min(id) from items)) as next from (select distinct \"key\" from k)")
def next_key(spark, sf):
    """The first stored key at or after each wanted one: stored keys take the place of nodes, the wanted ones look them up."""
    from ringspark.operators.tables import save

    wanted = d.table(spark, sf, "benchmark").select(ids.hash_id("text").alias("key")).distinct()
    stored = d.item_keys(spark, sf)
    # within the leading digits of a key if there is one, else the least of all that follow
    near = wanted.withColumn("b", F.substring("key", 1, 3)).join(stored.withColumn("b", F.substring("id", 1, 3)), "b").where("id >= key").groupBy("key").agg(F.min("id").alias("near"))
    least = save(stored.groupBy(F.substring("id", 1, 3).alias("b")).agg(F.min("id").alias("least")), "least")  # 4096 rows at most
    after = wanted.join(F.broadcast(least), F.substring("key", 1, 3) < F.col("b"), "left").groupBy("key").agg(F.min("least").alias("after"))
    first = least.agg(F.min("least").alias("first"))
    return wanted.join(near, "key", "left").join(after, "key", "left").crossJoin(F.broadcast(first)).select("key", F.coalesce("near", "after", "first").alias("next"))


@query(f"with {d.ITEMS}, p as (select id, row_number() over (order by id) as pos from items where id >= repeat('8', 40) qualify pos <= 65), s as (select count(*) > 64 as more, max(id) filter (pos <= 64) as last from p) select id, not more as complete, case when more then {d.sql_add('last', '(repeat(chr(48), 39) || chr(49))')} end as next from p, s where pos <= 64")
def page_keys(spark, sf):
    return store.page(d.item_keys(spark, sf), "8" * 40, 64)


@query(f"with {_FIRST} select ns, id, size, expiration, seq from stored where seq % 3 <> 0")
def delete_keys(spark, sf):
    stored = store.put_first(None, d.objects(spark, sf))
    return store.delete(stored, stored.where("seq % 3 = 0"))


@query(f"with {_FIRST} select ns, id, expiration from stored where expiration >= 1 and expiration < {NOW}")
def expire_victims(spark, sf):
    return store.expired(store.put_first(None, d.objects(spark, sf)), NOW).select("ns", "id", "expiration")


@query(f"with {_FIRST} select ns, count(*)::BIGINT as n from stored where expiration > {NOW} + 900 group by ns")
def worth_repair(spark, sf):
    return store.worth_repair(store.put_first(None, d.objects(spark, sf)), NOW).groupBy("ns").agg(F.count("*").alias("n"))


@query(f"with {d.OBJECTS} select (expiration >> 16)::BIGINT as bin_high, ((expiration + 255) // 256 * 256)::BIGINT as bin, count(*)::BIGINT as n, sum(size)::BIGINT as bytes from objects group by 1, 2")
def expire_bins(spark, sf):
    return store.expiry_bins(d.objects(spark, sf)).groupBy("bin_high", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


_QUOTA = 50_000_000


@query(f"with {d.OBJECTS}, u as (select *, sum(size) over (partition by ns order by seq rows unbounded preceding)::BIGINT as used from objects), p as (select *, (used * 100 // {_QUOTA})::BIGINT as percent from u) select ns, id, size, expiration, seq, used, percent, case when percent > 100 then 'DISKFULL' when percent > 90 then 'EXPIRE' else 'OK' end as action from p")
def quota_running(spark, sf):
    return store.running_quota(d.objects(spark, sf), _QUOTA)


@query(f"with {_FIRST} select ns, count(*)::BIGINT as n, sum(size)::BIGINT as bytes, min(expiration) filter (expiration > 0) as first_expiration from stored group by ns")
def store_totals(spark, sf):
    return store.totals(store.put_first(None, d.objects(spark, sf)))


_WRITES = "writes as (select sha1('user.' || user_id) as id, (event_id % 50)::BIGINT as version, event_id as seq from events)"


def _writes(spark, sf):
    e = d.table(spark, sf, "events")
    return e.select(F.sha1(F.concat(F.lit("user."), F.col("user_id").cast("string")).cast("binary")).alias("id"), (F.col("event_id") % 50).alias("version"), F.col("event_id").alias("seq"))


@query(f"with {_WRITES} select id, version, seq, n from (select *, count(*) over (partition by id) as n from writes) qualify row_number() over (partition by id order by version desc, seq desc) = 1")
def versioned_latest(spark, sf):
    return store.latest_version(_writes(spark, sf))


@query(f"with {_WRITES}, s as (select *, max(version) over (partition by id order by seq rows between unbounded preceding and 1 preceding) > version as old from writes) select id, version, seq, case when old then 'STALE' else 'OK' end as status from s")
def version_status(spark, sf):
    return store.version_status(_writes(spark, sf))


@query("""with w as (select sha1('conv.' || (conv_id % 20)) as id, sha1(coalesce(text, '')) as h, min(conv_id * 1000 + turn) as seq from conversations group by 1, 2)
select id, count(*)::BIGINT as n, sha1(string_agg(h, ',' order by seq, h)) as digest from w group by id""")
def append_set_merge(spark, sf):
    c = d.table(spark, sf, "conversations")
    key = F.sha1(F.concat(F.lit("conv."), (F.col("conv_id") % 20).cast("string")).cast("binary"))
    return store.merge_sets(c.select(key.alias("id"), F.coalesce("text", F.lit("")).alias("data"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq")))


@query("""with b as (select doc_id, case doc_id % 3 when 0 then 'content' when 1 then 'signed' else 'set' end as ctype, doc_id % 5 = 0 as broken from documents where text is not null)
select doc_id, ctype, (ctype = 'set' or not broken) as valid from b""")
def verify_blocks(spark, sf):
    t = d.table(spark, sf, "documents").where("text is not null")
    kind = F.when(F.col("doc_id") % 3 == 0, "content").when(F.col("doc_id") % 3 == 1, "signed").otherwise("set")
    broken = F.when(F.col("doc_id") % 5 == 0, "x").otherwise("")
    signed = F.sha1(F.concat(F.lit("key"), F.col("doc_id").cast("string"), broken).cast("binary"))
    b = t.select("doc_id", kind.alias("ctype"), F.concat("text", broken).alias("data"), F.lit("key").alias("owner_key"), F.col("doc_id").cast("string").alias("salt"), F.when(kind == "content", ids.hash_id("text")).otherwise(signed).alias("id"))
    return store.verified(b).select("doc_id", "ctype", "valid")


@query("""with r as (select (l_orderkey % 200)::BIGINT as "key", case when l_linenumber % 3 = 0 and l_orderkey % 4 < 1 then 'OK' when l_quantity > 45 then 'DISKFULL' else 'ERR' end as status from lineitem)
select "key", count(*) filter (status = 'OK')::BIGINT as good, case when count(*) filter (status = 'OK') >= 40 then 'OK' when bool_or(status = 'DISKFULL') then 'DISKFULL' else 'ERR' end as status from r group by 1""")
def store_status_reduce(spark, sf):
    r = d.table(spark, sf, "lineitem")
    status = F.when((F.col("l_linenumber") % 3 == 0) & (F.col("l_orderkey") % 4 < 1), "OK").when(F.col("l_quantity") > 45, "DISKFULL").otherwise("ERR")
    return store.store_status(r.select((F.col("l_orderkey") % 200).alias("key"), status.alias("status")), 40)


_SIDES = """sides as (select sha1(user_id::VARCHAR) as id, case when user_id % 2 = 0 then 'signed' else 'set' end as kind, max(event_id % 1000) filter (event_id % 3 <> 1) as va, max(event_id % 1000) filter (event_id % 3 <> 2) as vb from events group by 1, 2)"""


@query(f"""with {_SIDES} select id, kind, 'left' as src, 'right' as dst from sides where va is not null and (vb is null or kind = 'set' and va <> vb or kind = 'signed' and va > vb)
union all select id, kind, 'right', 'left' from sides where vb is not null and (va is null or kind = 'set' and va <> vb or kind = 'signed' and va < vb)""")
def repair_direction(spark, sf):
    e = d.table(spark, sf, "events")
    side = lambda r: e.where(F.col("event_id") % 3 != r).groupBy(F.sha1(F.col("user_id").cast("string").cast("binary")).alias("id"), F.when(F.col("user_id") % 2 == 0, "signed").otherwise("set").alias("kind")).agg(F.max(F.col("event_id") % 1000).alias("version"))
    return store.repair_direction(side(1), side(2))


_CHUNKS = "raw as (select page_id as name, hex(encode(html)) as h from pages where html is not null), cut as (select name, pos, unhex(substr(h, (pos * 2048 + 1)::INT, 2048)) as piece from raw, lateral (select unnest(range(greatest(1, (length(h) + 2047) // 2048))) as pos) t), chunks as (select name, pos, sha1(piece) as id, octet_length(piece)::BIGINT as n_bytes from cut)"


def _files(spark, sf):
    return d.table(spark, sf, "pages").where("html is not null").select(F.col("page_id").alias("name"), F.col("html").cast("binary").alias("data"))


@query(f"with {_CHUNKS} select * from chunks")
def file_chunks(spark, sf):
    return store.chunks(_files(spark, sf), 1024)


@query(f"""with recursive {_CHUNKS}, size as (select name, count(*) as n from chunks group by name), up1 as (select name, pos // 4 as pos, sha1(unhex(string_agg(id, '' order by pos))) as id from chunks group by 1, 2),
up2 as (select name, pos // 4 as pos, sha1(unhex(string_agg(id, '' order by pos))) as id from up1 join size using (name) where n > 4 group by 1, 2),
up3 as (select name, pos // 4 as pos, sha1(unhex(string_agg(id, '' order by pos))) as id from up2 join size using (name) where n > 16 group by 1, 2),
up4 as (select name, pos // 4 as pos, sha1(unhex(string_agg(id, '' order by pos))) as id from up3 join size using (name) where n > 64 group by 1, 2),
up5 as (select name, pos // 4 as pos, sha1(unhex(string_agg(id, '' order by pos))) as id from up4 join size using (name) where n > 256 group by 1, 2)
select name, 0 as level, pos, id from chunks union all select name, 1, pos, id from up1 union all select name, 2, pos, id from up2 union all select name, 3, pos, id from up3 union all select name, 4, pos, id from up4 union all select name, 5, pos, id from up5""")
def file_hash_tree(spark, sf):
    return store.hash_tree(store.chunks(_files(spark, sf), 1024))


_PARTS = "parts as (select l_orderkey as name, (l_partkey % 40 * 100)::BIGINT as start, (l_partkey % 40 * 100 + l_quantity::BIGINT * 20)::BIGINT as stop, 2000::BIGINT as total from lineitem)"


@query(f"""with {_PARTS}, r as (select *, max(stop) over (partition by name order by start, stop rows between unbounded preceding and 1 preceding) as reach from parts),
g as (select name, total, start, case when start > coalesce(reach, 0) then 1 else 0 end as gap, greatest(0, stop - greatest(start, coalesce(reach, 0))) as fresh from r)
select name, (sum(gap) + max((start = 0)::INT))::BIGINT as n_islands, sum(fresh)::BIGINT as covered, sum(fresh) = 2000 as complete from g group by name""")
def chunk_reassembly_gaps(spark, sf):
    line = d.table(spark, sf, "lineitem")
    start = F.col("l_partkey") % 40 * 100
    return store.coverage(line.select(F.col("l_orderkey").alias("name"), start.alias("start"), (start + F.col("l_quantity").cast("long") * 20).alias("stop"), F.lit(2000).cast("long").alias("total")))


def _sql_slots(x: str, depth: int) -> str:
    one = lambda k: f"('0x' || substr({x}, {1 + 3 * (k // 2)}, 3))::INT"
    return " || ".join(f"printf('%02d', {one(k)} & 63)" if k % 2 else f"printf('%02d', {one(k)} >> 6)" for k in range(depth)) or "''"


_LEVELS = d.ITEMS + ", l0 as (select 0 as depth, '' as prefix, count(*)::BIGINT as n from items)" + "".join(
    f", l{k} as (select {k} as depth, {_sql_slots('id', k)} as prefix, count(*)::BIGINT as n from items where {_sql_slots('id', k - 1)} in (select prefix from l{k - 1} where n > 64) group by 2)" for k in range(1, 6)
) + ", shape as (" + " union all ".join(f"select * from l{k}" for k in range(6)) + " )"


@query(f"with {_LEVELS} select depth, prefix, n, n <= 64 as is_leaf from shape where n > 0 or depth = 0")
def merkle_shape(spark, sf):
    return merkle.shape(d.item_keys(spark, sf))


_REVERSED = "(" + " || ".join(f"substr(id, {39 - 2 * i}, 2)" for i in range(20)) + ")"


@query(f"with {_LEVELS} select depth, prefix, hash from (" + " union all ".join(f"select s.depth, s.prefix, sha1(unhex(string_agg({_REVERSED}, '' order by id))) as hash from items i join shape s on s.depth = {k} and s.n <= 64 and s.prefix = {_sql_slots('id', k)} group by 1, 2" for k in range(6)) + ")")
def merkle_leaf_hash(spark, sf):
    return merkle.hashes(d.item_keys(spark, sf)).where("is_leaf").select("depth", "prefix", "hash")


def _sql_root(levels: str, deepest: int = 5) -> str:
    """Hashes from the deepest level up, unrolled."""
    leaf = lambda k: f"select s.prefix, sha1(unhex(string_agg({_REVERSED}, '' order by id))) as hash from items i join shape s on s.depth = {k} and s.n <= 64 and s.prefix = {_sql_slots('id', k)} group by 1"
    out = [f"h{deepest} as ({leaf(deepest)})"]
    for k in range(deepest - 1, -1, -1):
        inner = f"select p.prefix, sha1(unhex(string_agg(coalesce(c.hash, repeat('0', 40)), '' order by s))) as hash from (select prefix from shape where depth = {k} and n > 64) p cross join (select unnest(range(64)) as s) r left join h{k + 1} c on c.prefix = p.prefix || printf('%02d', s) group by 1"
        out.append(f"h{k} as ({leaf(k)} union all {inner})")
    return levels + ", " + ", ".join(out)


@query(f"with {_sql_root(_LEVELS)} select hash, (select count(*) from items)::BIGINT as n from h0")
def merkle_root(spark, sf):
    return merkle.hashes(d.item_keys(spark, sf)).where("depth = 0").select("hash", "n")


@query(f"""with {_LEVELS}, a as (select depth, count(*) as present, count(*) filter (n > 64) as inn, coalesce(sum(n) filter (n <= 64), 0) as keys from shape where n > 0 or depth = 0 group by depth),
b as (select a.depth, coalesce(64 * u.inn, a.present) as nodes, a.inn, a.present, a.keys from a left join a u on a.depth = u.depth + 1)
select depth, sum(nodes)::BIGINT as nodes, sum(nodes - inn)::BIGINT as leaves, sum(inn)::BIGINT as "inner", sum(nodes - present)::BIGINT as empty_leaves, sum(keys)::BIGINT as keys from b group by rollup (depth)""")
def merkle_stats(spark, sf):
    return merkle.statistics(d.item_keys(spark, sf))


@query(f"with {d.ITEMS} select id from items where id >= repeat('f0', 20) or id <= repeat('10', 20) order by id < repeat('f0', 20), id limit 100")
def key_range_wrap(spark, sf):
    return merkle.key_range(d.item_keys(spark, sf), "f0" * 20, "10" * 20, 100)


_DIFF = f"with {d.ITEMS}, a as (select id from items where substr(id, 38, 2) <> '00'), b as (select id from items where substr(id, 38, 2) <> '11') select id, 'left' as missing from b where id not in (select id from a) union all select id, 'right' from a where id not in (select id from b)"


def _sides(spark, sf):
    k = d.item_keys(spark, sf)
    return k.where("substr(id, 38, 2) <> '00'"), k.where("substr(id, 38, 2) <> '11'")


@query(_DIFF)
def merkle_diff(spark, sf):
    return merkle.difference(*_sides(spark, sf))


@query(_DIFF)
def merkle_diff_pruned(spark, sf):
    return merkle.pruned_difference(*_sides(spark, sf))


_M, _N = 3, 6


def _blocks(spark, sf):
    return d.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").cast("binary").alias("data"))


@query(f"""with b as (select item_id as id, hex(encode(text)) as h, octet_length(encode(text)) as rawlen from benchmark), s as (select id, rawlen, (rawlen + {2 * _M} - 1) // {2 * _M} as stripes, rpad(h, ((rawlen + {2 * _M} - 1) // {2 * _M} * {4 * _M})::INT, '0') as h from b),
w as (select id, rawlen, i // {_M} as stripe, i % {_M} as j, ('0x' || substr(h, (i * 4 + 1)::INT, 4))::BIGINT as word from s, lateral (select unnest(range(stripes * {_M})) as i) t),
f as (select id, rawlen, x, stripe, sum(word * (power(x, j)::BIGINT % 65537))::BIGINT % 65537 as e from w, (select unnest(range(1, {_N + 1})) as x) r group by all)
select id, x::INT as x, rawlen::INT as rawlen, sha1(string_agg(e::VARCHAR, ',' order by stripe)) as digest from f group by all""")
def erasure_encode(spark, sf):
    f = erasure.encode(_blocks(spark, sf), _M, _N)
    return f.select("id", "x", "rawlen", F.sha1(F.array_join(F.col("elements").cast("array<string>"), ",").cast("binary")).alias("digest"))


@query("select item_id as id, true as same from benchmark")
def erasure_roundtrip(spark, sf):
    b = _blocks(spark, sf)
    kept = erasure.encode(b, _M, _N).where("(id + x) % 2 = 0")  # half of the fragments are lost
    return erasure.decode(kept, _M).withColumnRenamed("data", "back").join(b, "id").select("id", (F.col("back") == F.col("data")).alias("same"))


@query("""with l as (select doc_id, octet_length(encode(coalesce(text, ''))) as n from documents), m as (select *, greatest(1, (n + 1209) // 1210) as m from l)
select doc_id, (case when n // m + (4 + m) * 2 > 1210 then m + 1 else m end)::INT as m from m""")
def fragments_needed(spark, sf):
    t = d.table(spark, sf, "documents")
    return t.select("doc_id", erasure.fragments_needed(F.octet_length(F.coalesce("text", F.lit(""))), 1210).alias("m"))
