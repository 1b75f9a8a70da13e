"""The operators' queries over the whole test tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import bpe, chat, counts, decontaminate, order, quality, secrets, simhash, suffix, urls
from quadloom.llm.common import fresh_path, table

#: The text of both turns of the extra conversation -1.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"
#: Key of the training order.
ORDER_KEY = "epoch-0"


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is: in QUADLOOM_TOKENIZERS if that is set, else where its package says."""
    folder = os.environ.get("QUADLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards are written to the shared folder; the rows are what they hold."""
    path = fresh_path(spark, "shards")
    order.write_shards(order.training_order(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), ORDER_KEY, stable=True), path)
    return order.read_back(spark, path)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.model_from(docs, table(spark, sf_dir, "labels")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CONTROL_TEXT).alias("text")) for k, r in enumerate(("user", "assistant"))))).alias("row")).select("row.*")
    return chat.digests(chat.formatted(rows.unionByName(extra)))


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judged(pages, urls.production_list(pages))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_decontamination, op3_training_order, op4_quality_rules, op5_chat_format, op6_repeated_strings, op7_near_duplicates, op8_token_counts, op9_bpe_round_trip, op10_url_filter, pipeline)
}

_ESCAPED = "replace(replace({0}, '\\', '\\\\'), '<|', '<\\|')"

OP5_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}'))
select cast(conv_id as bigint) as conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('<|im_start|>') + length(replace({_ESCAPED.format('role')}, chr(10), '<|nl|>')) + 1 + length({_ESCAPED.format('text')}) + length('<|im_end|>') + 1) as bigint) as formatted_chars,
  regexp_full_match(string_agg(case role when 'system' then 'S' when 'user' then 'U' when 'assistant' then 'A' when 'tool' then 'T' else 'X' end, '' order by turn, role, text), 'S?UT*A([UT]T*A)*') as valid
from turns group by conv_id
"""

OP6_SQL = f"""
with docs as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
starts as (select r, unnest(range(length(h) // 2 - {suffix.LENGTH - 1})) as s from docs where length(h) >= {2 * suffix.LENGTH}),
prints as (select r, s, md5(substr(h, 2 * s + 1, {2 * suffix.LENGTH})) as p from starts join docs using (r)),
twice as (select p from prints group by p having count(*) > 1),
hits as (select r, s from prints semi join twice using (p)),
marks as (select r, s, case when s > max(s + {suffix.LENGTH}) over (partition by r order by s rows between unbounded preceding and 1 preceding) then 1 else 0 end as cut from hits),
runs as (select r, s, sum(cut) over (partition by r order by s) as run from marks),
spans as (select r, min(s) as a, max(s) + {suffix.LENGTH} as b from runs group by r, run),
gaps as (select r, coalesce(lag(b) over (partition by r order by a), 0) as a, a as b from spans
  union all select r, max(b), null from spans group by r),
kept as (select r, string_agg(substr(h, 2 * gaps.a + 1, 2 * (coalesce(gaps.b, length(h) // 2) - gaps.a)), '' order by gaps.a) as k from gaps join docs using (r) group by r),
sums as (select r, count(*) as n_spans, sum(b - a) as n_removed from spans group by r)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from docs left join sums using (r) left join kept using (r)
"""


def _op10_sql() -> str:
    rules = sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))", h + p, v) for h, p, v in rules]
    rule = " ".join(f"when {c} then '{n}'" for c, n, _ in fits)
    says = " ".join(f"when {c} then '{v}'" for c, _, v in fits)
    listed = " or ".join(f"host = '{n}.{u}' or ends_with(host, '.{n}.{u}')" for n in urls.LISTED_NAMES for u in urls.LISTED_UNDER)
    return f"""
with parsed as (
  select page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
thin as (select distinct host || path as a from parsed where host <> '' and path <> '' and length(html) - length(replace(html, '<p>', '')) < {3 * urls.PARAGRAPHS}),
found as (select page_id, host, path, ({listed} or host <> '' and path <> '' and host || path in (select a from thin)) as listed from parsed)
select page_id, host, path, case {rule} end as rule, case {says} when listed then 'block' else 'allow' end as verdict, listed from found
"""


ORACLE_SQL: dict[str, str] = {"op5_chat_format": OP5_SQL, "op6_repeated_strings": OP6_SQL, "op10_url_filter": _op10_sql()}
