"""The keyed store and its block types as table operations: put, get, page, expire, quota, merge, verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringspark.functions import ids


def put_first(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """stored with the rows of new (ns, id, ..., seq) whose key is not there yet; within new the lowest seq wins.

    The first row of a key comes from a partial aggregation, so a key that is written again and again is no hot spot.
    """
    rest = [c for c in new.columns if c not in ("ns", "id")]
    first = new.groupBy("ns", "id").agg(F.min_by(F.struct(*rest), "seq").alias("row")).select("ns", "id", "row.*")
    if stored is None:
        return first
    return stored.unionByName(first.join(stored.select("ns", "id"), ["ns", "id"], "left_anti").select(stored.columns))


def get(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (ns, id) with the stored columns and status: OK or NOTFOUND."""
    found = stored.withColumn("found", F.lit(True))
    return wanted.join(found, ["ns", "id"], "left").withColumn("status", F.when(F.col("found"), "OK").otherwise("NOTFOUND")).drop("found")


def page(stored: DataFrame, start: str, count: int) -> DataFrame:
    """The first `count` ids from start on (no wrap), with complete (nothing follows) and next (where to go on)."""
    ahead = stored.where(F.col("id") >= start).select("id").orderBy("id").limit(count + 1)
    ranked = ahead.withColumn("at", F.row_number().over(Window.orderBy("id")))  # at most count + 1 rows
    more = F.max("at").over(Window.partitionBy(F.lit(0))) > count
    last = F.max(F.when(F.col("at") <= count, F.col("id"))).over(Window.partitionBy(F.lit(0)))
    return ranked.select("id", "at", (~more).alias("complete"), F.when(more, ids.increment(last)).alias("next")).where(F.col("at") <= count).drop("at")


def delete(stored: DataFrame, gone: DataFrame) -> DataFrame:
    return stored.join(gone.select("ns", "id"), ["ns", "id"], "left_anti")


def expired(stored: DataFrame, deadline: int | Column, start: int = 1) -> DataFrame:
    """The rows whose expiration is in [start, deadline); 0 means never."""
    return stored.where((F.col("expiration") >= start) & (F.col("expiration") < deadline))


def worth_repair(stored: DataFrame, now: int, margin: int = 900) -> DataFrame:
    return stored.where(F.col("expiration") > now + margin)


def expiry_bins(stored: DataFrame) -> DataFrame:
    """stored with the file bin of each row: the upper bits, and the expiration rounded up to 256 seconds."""
    return stored.withColumn("bin_high", F.shiftright("expiration", 16)).withColumn("bin", F.shiftleft(F.shiftright(F.col("expiration") + 255, 8), 8))


def running_quota(stored: DataFrame, quota: int, full: int = 90) -> DataFrame:
    """Each namespace's size after each write in order of seq, its percentage of the quota, and what that asks for."""
    order = Window.partitionBy("ns").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    used = stored.withColumn("used", F.sum("size").over(order))
    percent = F.floor(F.col("used") * 100 / F.lit(quota)).cast("long")
    used = used.withColumn("percent", percent)
    return used.withColumn("action", F.when(F.col("percent") > 100, "DISKFULL").when(F.col("percent") > full, "EXPIRE").otherwise("OK"))


def totals(stored: DataFrame) -> DataFrame:
    """ns, n, bytes, first_expiration of what can expire."""
    return stored.groupBy("ns").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min(F.when(F.col("expiration") > 0, F.col("expiration"))).alias("first_expiration"))


def latest_version(writes: DataFrame) -> DataFrame:
    """id, version, seq, n of signed blocks: the highest version stays; of equal ones the later write."""
    best = F.max_by(F.struct("version", "seq"), F.struct("version", "seq"))
    return writes.groupBy("id").agg(best.alias("best"), F.count("*").alias("n")).select("id", "best.version", "best.seq", "n")


def version_status(writes: DataFrame) -> DataFrame:
    """writes with status in order of seq: STALE if a higher version was there before."""
    before = F.max("version").over(Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return writes.withColumn("status", F.when(before > F.col("version"), "STALE").otherwise("OK"))


def merge_sets(writes: DataFrame) -> DataFrame:
    """id, n, digest of append-set blocks: elements (column data) by first arrival (seq), each different one once.

    First an aggregate by element, so that an element that comes again and again is met once.
    """
    element = writes.groupBy("id", F.sha1(F.col("data").cast("binary")).alias("h")).agg(F.min("seq").alias("seq"))
    return element.groupBy("id").agg(F.count("*").alias("n"), F.sha1(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("seq", "h"))), lambda x: x["h"])).cast("binary")).alias("digest"))


def verified(blocks: DataFrame) -> DataFrame:
    """blocks (id, ctype, data, owner_key, salt) with valid: content-hash blocks by their hash, signed ones by the hash of key and salt."""
    data = F.col("data").cast("binary")
    signed = F.sha1(F.concat(F.col("owner_key"), F.col("salt")).cast("binary"))
    return blocks.withColumn("valid", F.when(F.col("ctype") == "content", F.sha1(data) == F.col("id")).when(F.col("ctype") == "signed", signed == F.col("id")).otherwise(True))


def store_status(results: DataFrame, least: int) -> DataFrame:
    """key, good, status of a store on several nodes: OK if enough were good, else DISKFULL if any was, else ERR."""
    good = F.count_if(F.col("status") == "OK")
    full = F.coalesce(F.bool_or(F.col("status") == "DISKFULL"), F.lit(False))
    return results.groupBy("key").agg(good.alias("good"), F.when(good >= least, "OK").when(full, "DISKFULL").otherwise("ERR").alias("status"))


def repair_direction(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, kind, src, dst: which side's copy (left, right) goes to the other.

    Both sides: id, kind (signed or set), version. A missing side gets a copy; signed blocks go from the newer version to
    the older; sets that differ go both ways.
    """
    a = left.select("id", "kind", F.col("version").alias("va"))
    b = right.select("id", F.col("kind").alias("kind_b"), F.col("version").alias("vb"))
    both = a.join(b, "id", "full_outer").withColumn("kind", F.coalesce("kind", "kind_b"))
    to_right, to_left = F.struct(F.lit("left").alias("src"), F.lit("right").alias("dst")), F.struct(F.lit("right").alias("src"), F.lit("left").alias("dst"))
    moves = (
        F.when(F.col("vb").isNull(), F.array(to_right))
        .when(F.col("va").isNull(), F.array(to_left))
        .when((F.col("kind") == "set") & (F.col("va") != F.col("vb")), F.array(to_right, to_left))
        .when((F.col("kind") == "signed") & (F.col("va") > F.col("vb")), F.array(to_right))
        .when((F.col("kind") == "signed") & (F.col("va") < F.col("vb")), F.array(to_left))
    )
    return both.withColumn("moves", moves).where("moves is not null").select("id", "kind", F.inline("moves"))


def chunks(files: DataFrame, size: int) -> DataFrame:
    """name, pos, id, n_bytes: files (name, data) cut into blocks of `size` bytes; an empty file has one empty block."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / size)).cast("int")
    cut = files.select("name", "data", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    piece = F.substring(F.col("data"), F.col("pos") * size + 1, F.lit(size))
    return cut.select("name", F.col("pos").cast("long").alias("pos"), F.sha1(piece).alias("id"), F.octet_length(piece).cast("long").alias("n_bytes"))


def hash_tree(leaves: DataFrame, fan: int = 4) -> DataFrame:
    """name, level, pos, id: groups of `fan` children's hashes, concatenated and hashed, up to one root; one block still gets a root.

    leaves: name, pos, id. A loop of as many aggregations as the tallest tree has levels.
    """
    from ringspark.operators.tables import save

    now = leaves.select("name", F.lit(0).alias("level"), "pos", "id")
    out, level = now, 0
    while True:
        level += 1
        ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]), "")  # at most `fan` of them
        now = now.groupBy("name", F.floor(F.col("pos") / fan).cast("long").alias("up")).agg(F.sha1(F.unhex(ordered)).alias("id"))
        now = save(now.select("name", F.lit(level).alias("level"), F.col("up").alias("pos"), "id"), "tree")
        out = out.union(now)
        tall = now.where("pos > 0").select("name").distinct()
        if tall.isEmpty():
            break
        now = now.join(tall, "name", "left_semi")
    return out


def expiry_rounds(stored: DataFrame, start: int, every: int) -> DataFrame:
    """stored with round: in which of the rounds at start, start + every, ... a row expires; null for never.

    A round at a moment takes what expires before that moment's whole minute and wasn't taken before.
    """
    due = F.floor(F.col("expiration") / 60) * 60 + 60
    number = F.greatest(F.lit(0).cast("long"), F.ceil((due - start) / every).cast("long"))
    return stored.withColumn("round", F.when(F.col("expiration") > 0, number))


def coverage(parts: DataFrame) -> DataFrame:
    """name, n_islands, covered, complete: chunks (name, start, stop, total) merged where they touch or overlap."""
    reach = F.max("stop").over(Window.partitionBy("name").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    seen = parts.withColumn("reach", F.coalesce(reach, F.lit(0)))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reach"))
    marked = seen.withColumn("fresh", fresh).withColumn("gap", (F.col("start") > F.col("reach")).cast("long"))
    found = marked.groupBy("name").agg((F.sum("gap") + F.max((F.col("start") == 0).cast("long"))).alias("n_islands"), F.sum("fresh").cast("long").alias("covered"), F.max("total").alias("total"))
    return found.select("name", "n_islands", "covered", (F.col("covered") == F.col("total")).alias("complete"))
