"""The queries opN_<name> of this subpackage, and their SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringspark.llm import chat, decontam, host_rules, html_text, langid, line_crf, mixing, pii, simhash, warc
from ringspark.llm.common import table


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(turns.union(more)))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return line_crf.classify(docs.select("doc_id", "text"), model).drop("text")


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs.select("doc_id", "text"), langid.train(docs)).drop("text")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("root")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_chat_windows, op2_pii_pseudonyms, op3_mix_sources, op4_host_quality_rules, op5_line_crf_quality, op6_warc_round_trip,
        op7_benchmark_decontamination, op8_language_id, op9_simhash_near_dedup, op10_html_text,
    )
    return {f.__name__: f for f in every}


_OP6 = """with p as (select page_id, encode(coalesce(html, '')) as data from pages), d as (select page_id, octet_length(data)::BIGINT as payload_bytes, sha256(data) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
 case when payload_bytes >= 100 and page_id <> first then first end as refers_to from f"""


def _op4() -> str:
    """The rules in DuckDB's SQL; rates, prior and verdicts for each rule as in host_rules.judge."""
    fails = ", ".join(f"({v})::INT as bad_{k}" for k, v in host_rules.RULES.items())
    sums = ", ".join(f"sum(bad_{k}) as x_{k}" for k in host_rules.RULES)
    moments = ", ".join(f"sum(x_{k}) / sum(n)::DOUBLE as mu_{k}, avg(x_{k} / n::DOUBLE) as p_{k}, avg((x_{k} / n::DOUBLE) ** 2) as pp_{k}" for k in host_rules.RULES)
    strength = ", ".join(f"least(greatest(mu_{k} * (1 - mu_{k}) / greatest(greatest(0, pp_{k} - p_{k} ** 2) - mu_{k} * (1 - mu_{k}) * inverse, 1e-6) - 1, 2.0), 1000.0) as s_{k}" for k in host_rules.RULES)
    rate = lambda k: f"case when mu_{k} > 0 and mu_{k} < 1 then (x_{k} + mu_{k} * s_{k}) / (n + s_{k}) else (x_{k} + 0.5 + mu_{k}) / (n + 2.0) end"
    return f"""with w as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
lines as (select r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from w),
win as (select r, i, array_to_string(words[i:i + 7], ' ') as t from (select r, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)),
rep as (select r, unnest(places) as i from (select r, list(i) as places from win group by r, t having count(*) > 1)),
cov as (select r, count(distinct i + j) as n from rep, (select unnest(range(8)) as j) group by r),
m as (select w.r, doc_id, source, len(words)::BIGINT as n_words, length(array_to_string(words, ''))::BIGINT as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT as n_symbols,
 len(l)::BIGINT as n_lines, (len(l) - len(list_distinct(l)))::BIGINT as n_dup_lines, coalesce(cov.n, 0)::BIGINT as n_repeat_words from w join lines using (r) left join cov using (r)),
b as (select *, {fails} from m), h as (select source, count(*) as n, {sums} from b group by source), t as (select {moments}, avg(1 / n::DOUBLE) as inverse from h), u as (select *, {strength} from t),
v as (select source, greatest({', '.join(map(rate, host_rules.RULES))}) > 0.5 as host_failed from h, u)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bad_short = 1 or bad_repeats = 1) as base_failed, not (bad_short = 1 or bad_repeats = 1) and not host_failed as kept
from b join v on b.source is not distinct from v.source"""


def oracle_sql() -> dict[str, str]:
    return {"op4_host_quality_rules": _op4(), "op6_warc_round_trip": _OP6}
