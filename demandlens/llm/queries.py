"""Queries of the training-data operators over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html_extract, langid, media, minhash, mixing, packing, quality, sharding, warc
from .common import scratch

#: Environment-independent name of the tokenizer; its folder is a parameter of the operator.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").alias("target_uri"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    path = scratch(spark, "warc")
    warc.write_archives(warc.with_revisits(rows, least=0), path)
    read = warc.read_archives(spark, path)
    full = F.col("record_type") == "response"
    payload = F.coalesce("payload", F.lit(b""))
    return read.select(
        warc.number(F.col("record_id")).alias("page_id"),
        F.when(full, F.octet_length(payload).cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, warc.sha1_base32(payload)).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        warc.number(F.col("refers_to")).alias("refers_to"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    samples = langid.learn(docs.filter("not held_out"))
    return langid.identify(docs, samples, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).taken()


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.quality_rules(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_media(media.store_texts(table(spark, sf_dir, "documents")))
    frame = lambda f: F.concat_ws(":", f["time_ms"].cast("string"), F.array_join(f["histogram"].cast("array<string>"), ","))
    feature = F.array_join(F.transform("frames", frame), ";")
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40, overhead=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    probe = spark.createDataFrame(probe, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(rows.unionByName(probe)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_media": op6_media,
    "op7_html": op7_html,
    "op8_sharding": op8_sharding,
    "op9_minhash": op9_minhash,
    "op10_chat": op10_chat,
    "pipeline": pipeline,
}

_GROUP = "('0x' || substr(h, {0}, 5))::BIGINT"
_BASE32 = " || ".join(f"substr('{warc.ALPHABET}', ((({_GROUP.format(5 * k + 1)}) >> {5 * (3 - j)}) & 31)::INT + 1, 1)" for k in range(8) for j in range(4))
_ESCAPED = "replace(text, '\\', '\\\\')"
for _c in chat.CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"
for _c in ("<|image:", "<|audio:", "<|document:"):
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

#: All pairs that share a shingle, and their closure.
_NEAR = """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
        x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
        both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        reach AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT both_ways.b, reach.root FROM reach JOIN both_ways ON both_ways.a = reach.id),
        least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least ON doc_id = id"""

ORACLE_SQL = {
    "op9_minhash": _NEAR,
    "op1_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM m""",
    "op10_chat": f"""
        WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
                   UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, {_ESCAPED} AS escaped FROM r),
        g AS (SELECT conv_id, count(*) AS n_turns,
                string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                sum(length('{chat.TURN}') + length(role) + length('{chat.BODY}') + length(escaped) + length('{chat.STOP}')) AS size
              FROM e GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
               sha256(loss) AS loss_sha256, size::BIGINT AS formatted_chars
        FROM g""",
}
