"""The thin queries over the operators of this subpackage, with the parameters used in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chat, decontaminate, lm, mixing, order_minhash, quality, secret_scan, sharding, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secret_scan.scan(docs, path_col="source")
    return found.select("doc_id", "nth", "start", F.length("candidate").alias("n_chars"), F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "is_secret")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("overlap.n_words").alias("n_words"),
        decontaminate.n_hit("overlap").alias("n_hit"),
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "overlap.items"), 256).alias("items_sha256"),
        (F.size("overlap.items") >= 2).alias("contaminated"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    speaker = F.when(F.col("id") == 0, "user").otherwise(chat.ASSISTANT)
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), speaker.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    # in these tables each turn answers the one before it
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    linked = turns.unionByName(extra).withColumn("node", F.row_number().over(order).cast("long"))
    linked = linked.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
    done = chat.format_trees(linked).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learn", chat.read_loss(F.col("formatted"), F.col("loss")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("learn").cast("long").alias("loss_chars"),
        F.sha2("learn", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    scored = lm.score(docs, docs.where(F.coalesce(part != 1, F.lit(False))))
    return scored.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(_table(spark, sf_dir, "pages"))
    return captures.select(
        F.col("capture_id").cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to_id").cast("long").alias("refers_to"),
    )


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edited(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_mixing": op2_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_sharding": op5_sharding,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_warc": op9_warc,
    "op10_order_minhash": op10_order_minhash,
}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op3_decontamination": f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
wins as (select distinct item, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') as win, least(8, len(w)) as k from (select item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct k from wins),
grams as (select rid, k, i, array_to_string(w[i : i + k - 1], ' ') as win from (select rid, w, k, unnest(range(1, cast(len(w) - k + 2 as bigint))) as i from d, sizes where len(w) >= k)),
hits as (select g.rid, g.i, g.k, v.item from grams g join wins v on g.k = v.k and g.win = v.win),
words as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + k)) as p from hits) group by rid),
items as (select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from hits group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join words using (rid) left join items using (rid)""",
    "op6_chat_formatting": r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) as body,
  length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '[', ''), '|', '')) as head from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
cast(3 + sum(body + head + 8) as bigint) as formatted_chars from e group by conv_id""",
    "op9_warc": """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select *, max(page_id) over (partition by payload_digest) as top from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
case when payload_bytes >= 1000 and page_id <> top then top end as refers_to from m""",
}
