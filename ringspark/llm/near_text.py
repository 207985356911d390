"""Near copies by the Jaccard similarity of word shingles, for texts as they are in a corpus.

1. Texts of the same set of shingles are one, and so are those whose SimHash fingerprints are linked (module simhash).
   Set signatures (least hashes) are cut into bands, and texts that share a band's value are candidates. At a
   similarity of 0.8 a pair shares none of 32 bands of four with a chance of 5e-8.
2. The exact similarity decides each candidate pair.
3. A value that more than `bucket` texts share isn't expanded into pairs. All its texts are compared with one of them, the
   one with most such values; what isn't near it gets another leader, `leaders` times. Where all texts of a value are
   then in one component, nothing is left to ask. Else the texts outside of its largest component (strays) are compared
   with those of other components that share one of their rarest shingles: two sets of a similarity of 0.8 share one of
   the n + 1 - ceil(0.8 n) first of each in any common order, so nothing is lost, and passages that many texts share
   come last in the order. What follows the shared shingle in both bounds what they share, which prunes most pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringspark.llm import simhash
from ringspark.llm.common import save, small_batches
from ringspark.llm.simhash import components

#: Pairs are near from NUMERATOR / DENOMINATOR on.
NUMERATOR, DENOMINATOR = 4, 5
#: Into how many parts the pairs of one leader are dealt.
SALT = 16


def shingles_of(text: str | None, words: int) -> np.ndarray:
    """The sorted set of hashes of all runs of words; only A-Z are lower-cased, words end at ASCII white space."""
    return np.unique(simhash.hashes_of(text, words))


def id_of(found: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh64_digest(found.tobytes(), 7), dtype="<i8")[0]) if len(found) else 0


def signatures(words: int, bands: int, rows: int):
    """A column function: tid (of the set of shingles), n (its size), fp (SimHash) and keys (one for each band; none without words)."""
    draw = np.random.default_rng(42)
    times = draw.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    @F.pandas_udf("tid long, n int, fp long, keys array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for t in batch:
                hashes = simhash.hashes_of(t, words)
                found, keys = np.unique(hashes), []
                if len(found):
                    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
                    for i in range(0, len(found), 2048):
                        np.minimum(least, (found[i : i + 2048, None] * times + plus).min(axis=0), out=least)
                    cut = least.reshape(bands, rows)
                    keys = [xxhash.xxh64_intdigest(cut[b].tobytes(), b) - (1 << 63) for b in range(bands)]
                out.append((id_of(found), len(found), simhash.majority(hashes), keys))
            yield pd.DataFrame(out, columns=["tid", "n", "fp", "keys"])

    return of


def sets_of(words: int):
    @F.pandas_udf("array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shingles_of(t, words).view(np.int64) for t in batch], dtype=object)

    return of


def judged(pairs: DataFrame, sets: DataFrame, salt: int = 1) -> DataFrame:
    """(a, b): the pairs whose sets are near. salt: the pairs of one a are dealt to so many parts, and its set goes to each."""
    left, right = sets.select(F.col("tid").alias("a"), F.col("sh").alias("sa")), sets.select(F.col("tid").alias("b"), F.col("sh").alias("sb"))
    by = ["a"]
    if salt > 1:
        pairs, by = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(salt)).cast("int")), ["a", "part"]
        left = left.join(pairs.select("a").distinct(), "a", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    both = pairs.join(right, "b").join(left, by).withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("common") * DENOMINATOR >= (F.size("sa") + F.size("sb") - F.col("common")) * NUMERATOR).select("a", "b")


def fits(a: str, b: str) -> Column:
    """Sets of these sizes can be near."""
    return F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR


def light_pairs(member: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of texts of each key (key, tid, n) that can be near by their sizes."""
    one, other = member.select("key", F.col("tid").alias("a"), F.col("n").alias("na")), member.select("key", F.col("tid").alias("b"), F.col("n").alias("nb"))
    return one.join(other, "key").where((F.col("a") < F.col("b")) & fits("na", "nb")).select("a", "b").distinct()


def led(heavy: DataFrame, have: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The near pairs of each key's leader, and the rows (key, tid, n, often) of heavy that are neither leaders nor near theirs."""
    best = heavy.groupBy("key").agg(F.max(F.struct("often", "tid")).alias("best")).select("key", F.col("best.tid").alias("a"))
    asked = save(heavy.join(best, "key").where("tid <> a").withColumnRenamed("tid", "b"), "text-led")
    near = save(judged(asked.select("a", "b").distinct(), have, SALT), "text-near")
    rest = asked.join(near, ["a", "b"], "left_anti").select("key", F.col("b").alias("tid"), "n", "often")
    return near, save(rest, "text-rest")


def most_frequent(sets: DataFrame, bucket: int, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that more than `bucket` texts of sets (sh) share, in order, and by how many; of the most frequent `most` at most.

    Only their counts are compared, by steps of a fourth of a power of two, so those that few texts share are left out first.
    """
    step = F.floor(F.log2("many") * 4).cast("int").alias("step")
    counts = sets.select(F.explode("sh").alias("sh")).groupBy("sh").agg(F.count("*").alias("many")).where(F.col("many") > bucket)
    counts = save(counts.select("sh", "many", step), "text-common")
    least, room = None, most
    for x in sorted(counts.groupBy("step").agg(F.count("*").alias("n")).collect(), reverse=True):  # 4 * 63 rows at most
        room -= x["n"]
        if room < 0:
            break
        least = x["step"]
    found = counts.where(F.lit(False) if least is None else F.col("step") >= least).select("sh", "many").toPandas().sort_values("sh")
    return found["sh"].to_numpy(dtype=np.int64), found["many"].to_numpy(dtype=np.int64)


def in_order(frequent: np.ndarray, many: np.ndarray):
    """A column function: shingles, those that aren't frequent first, then by how many texts share them; ties by value."""

    @F.pandas_udf("array<long>")
    def of(sets: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in sets:
            out = []
            for s in batch:
                sh, often = np.asarray(s, dtype=np.int64), np.zeros(len(s), dtype=np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, sh), len(frequent) - 1)
                    often = np.where(frequent[at] == sh, many[at], 0)
                out.append(sh[np.lexsort((sh, often))])
            yield pd.Series(out, dtype=object)

    return of


def rare_first(texts: DataFrame, have: DataFrame, bucket: int) -> DataFrame:
    """(tid, n, at, sh): of each text the shingles of which a near one shares one at least, those that few texts have first; at is the place.

    The order is the same for all texts, whatever shingles count as frequent, and any such order finds all near texts.
    """
    wide = save(texts.join(have, "tid").select("tid", "n", "sh"), "text-wide")
    need = F.col("n") + 1 - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR).cast("int")
    ranked = wide.select("tid", "n", in_order(*most_frequent(wide, bucket))("sh").alias("all"))
    return ranked.select("tid", "n", F.posexplode(F.slice("all", F.lit(1), need)).alias("at", "sh"))


def stray_links(heavy: DataFrame, have: DataFrame, roots: DataFrame, bucket: int) -> DataFrame | None:
    """(a, b): near pairs that join texts of heavy keys (key, tid, n) whose components (node, root) differ so far; None if there are none."""
    at = heavy.join(roots.withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    at = save(at.select("key", "tid", "n", "root"), "text-places")
    counts = at.groupBy("key", "root").agg(F.count("*").alias("many"))
    main = counts.groupBy("key").agg(F.max(F.struct("many", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("main.root").alias("main"))
    open_ = save(at.join(main, "key").groupBy("tid", "n", "root").agg(F.bool_or(F.col("root") != F.col("main")).alias("stray")), "text-open")
    if open_.isEmpty():
        return None
    first = save(rare_first(open_.select("tid", "n"), have, bucket).join(open_.select("tid", "root", "stray"), "tid"), "text-first")
    one = first.where("stray").select("sh", F.col("tid").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("root").alias("ra"))
    other = first.select("sh", F.col("tid").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("root").alias("rb"))
    # at the first shared shingle no more than what follows it can be shared; a near pair keeps that row
    left = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    enough = left * (NUMERATOR + DENOMINATOR) >= (F.col("na") + F.col("nb")) * NUMERATOR
    pairs = one.join(other, "sh").where((F.col("ra") != F.col("rb")) & enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return save(judged(save(pairs, "text-asked"), have), "text-strays")


def links(texts: DataFrame, sets: Callable[[DataFrame], DataFrame], known: DataFrame | None = None, bucket: int = 32, leaders: int = 2) -> DataFrame:
    """(a, b): links that join all texts (tid, n, keys) that are near, or linked by `known`, into components. sets: (tids) -> tid, sh."""
    keys = texts.select("tid", "n", F.explode("keys").alias("key"))
    shared = save(keys.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "text-keys")
    member = save(keys.join(shared, "key"), "text-members")
    pairs = save(light_pairs(member.where(F.col("many") <= bucket)), "text-pairs")
    heavy = member.where(F.col("many") > bucket)
    heavy = save(heavy.select("key", "tid", "n").join(heavy.groupBy("tid").agg(F.count("*").alias("often")), "tid"), "text-heavy")
    wanted = pairs.select(F.col("a").alias("tid")).union(pairs.select("b")).union(heavy.select("tid")).distinct()
    have = save(sets(wanted), "text-sets")
    out = save(judged(pairs, have), "text-links")
    if known is not None:
        out = out.union(known)
    rest = heavy
    for _ in range(leaders):
        if rest.isEmpty():
            return out
        near, rest = led(rest, have)
        out = out.union(near)
    more = stray_links(heavy, have, components(out), bucket)
    return out if more is None else out.union(more)


def simhash_links(texts: DataFrame, k: int = 2) -> DataFrame:
    """(a, b): links that join the texts (tid, fp) whose fingerprints are linked within k bits."""
    prints = save(texts.groupBy("fp").agg(F.min("tid").alias("first")), "text-prints")
    same = texts.join(prints, "fp").where("tid <> first").select(F.col("first").alias("a"), F.col("tid").alias("b"))
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_"))
    return same.union(simhash.links(prints.select("fp"), k).join(of("a"), "a").join(of("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b")))


def keep_one(docs: DataFrame, words: int = 5, bands: int = 32, rows: int = 4, bucket: int = 32, k: int = 2) -> DataFrame:
    """docs with one row of each component of near texts: that of the smallest doc_id, null last, then by hash of text.

    Near: SimHash fingerprints of shingles of `words` words that differ in at most k bits, or a Jaccard similarity of 0.8
    or more of the sets of shingles. Null texts and those without words are copies of each other. Rows with the same
    doc_id but other texts are rows of their own; rows alike in both are one. An empty table gives an empty one. Extra
    columns stay.
    """
    small_batches(docs.sparkSession)
    mark = F.xxhash64("text")
    signed = docs.select("doc_id", mark.alias("mark"), signatures(words, bands, rows)(F.col("text")).alias("s"))
    signed = save(signed.select("doc_id", "mark", "s.*"), "text-signatures")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    texts = signed.groupBy("tid").agg(F.min(order).alias("least"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys"))
    texts = save(texts, "texts")

    def rows_at(places: DataFrame) -> DataFrame:
        """The rows of docs at places (doc_id, mark); one of those that are all the same."""
        at = places.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).hint("shuffle_hash")
        return docs.join(at, docs.doc_id.eqNullSafe(F.col("_id")) & (mark == F.col("_mark")), "left_semi")

    def sets(wanted: DataFrame) -> DataFrame:
        found = rows_at(texts.join(wanted, "tid", "left_semi").select("least.doc_id", "least.mark"))
        sh = save(found.select(sets_of(words)(F.col("text")).alias("sh")), "text-found")
        tid = found_id()
        return sh.select(tid("sh").alias("tid"), "sh").dropDuplicates(["tid"])

    known = save(simhash_links(texts.select("tid", "fp"), k), "text-known")
    joined = components(links(texts, sets, known, bucket))
    rooted = texts.join(joined, texts.tid == joined.node, "left").select("least", F.coalesce("root", "tid").alias("root"))
    chosen = save(rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.mark"), "text-chosen")
    often = signed.groupBy("doc_id", "mark").agg(F.count("*").alias("many")).withColumnsRenamed({"doc_id": "_d", "mark": "_m"})
    chosen = save(chosen.join(often, chosen.doc_id.eqNullSafe(F.col("_d")) & (chosen.mark == F.col("_m"))).select("doc_id", "mark", "many"), "text-kept")
    once = rows_at(chosen.where("many = 1"))
    again = rows_at(chosen.where("many > 1")).withColumn("_mark", mark).dropDuplicates(["doc_id", "_mark"]).drop("_mark")
    return once.select(docs.columns).union(again.select(docs.columns))


def found_id():
    @F.pandas_udf("long")
    def of(sets: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in sets:
            yield pd.Series([id_of(np.asarray(s).view(np.uint64)) for s in batch], dtype="int64")

    return of
