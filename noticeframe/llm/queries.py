"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clustering, decontam, interactions, licenses, packing, pii, quality, sharding, simhash, substring, warc
from .common import durable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = packing.VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = chat.read_back(chat.format_conversations(turns))
    loss = "array_join(transform(filter(turns, t -> t.loss), t -> t.text), '')"
    return back.select(
        "conv_id",
        F.expr("cast(size(turns) AS bigint)").alias("n_turns"),
        F.expr("sha2(array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), ''), 256)").alias("turns_sha256"),
        F.expr(f"cast(length({loss}) AS bigint)").alias("loss_chars"),
        F.expr(f"sha2({loss}, 256)").alias("loss_sha256"),
        F.expr("cast(length(formatted) AS bigint)").alias("formatted_chars"),
        F.col("rewritten_at").isNotNull().alias("rewrites_history"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda k: F.expr(f"cast(size(filter(pii, x -> x.k = '{k}')) AS bigint)").alias(f"n_{k}")
    base = pii.span_text(f"filter(pii, x -> x.r < {len(pii.BASE_KINDS)})")
    return found.select(
        "doc_id",
        *[count(k) for k in pii.BASE_KINDS],
        F.expr(f"sha2({base}, 256)").alias("base_sha256"),
        F.expr(pii.span_text("pii")).alias("spans"),
        count("iban"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


VISITS = 6


def page_captures(pages: DataFrame) -> DataFrame:
    """A crawl of ``pages``: each is visited six times under changing spellings of its URL.

    Visits 0 and 3 are full responses, of two versions of the page, the others not modified. One page in five has no
    first response, one in five no second; one in three has no ETag, only a date; one in four answers its last visit with the old
    version's validator.
    """
    n, p = F.col("visit"), F.col("page_id")
    seen = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("sum")).withColumn("visit", F.explode(F.sequence(F.lit(0), F.lit(VISITS - 1))))
    seen = seen.where(~((n == 0) & (p % 5 == 0)) & ~((n == 3) & (p % 5 == 1)))
    version = F.when((n < 3) | (n == 5) & (p % 4 == 0), 1).otherwise(2).cast("string")
    full = n.isin(0, 3)
    tag = F.when(p % 3 != 0, F.concat(F.when(full, "W/").otherwise(""), F.lit('"'), "sum", F.lit("-"), version, F.lit('"')))
    dated = F.concat(F.lit("Mon, 0"), version, F.lit(" Jan 2024 00:00:00 GMT"))
    bare = F.regexp_replace("url", "#.*$", "")
    url = (
        F.when(n % 3 == 0, F.col("url"))
        .when(n % 3 == 1, F.concat(bare, F.when(F.instr(bare, "?") > 0, "&").otherwise("?"), F.lit("utm_source=v"), n.cast("string")))
        .otherwise(F.regexp_replace("url", "^http://", "https://"))
    )
    at = 10 * n + p % 7
    pairs = lambda *kv: F.create_map(*[F.lit(x) if i % 2 == 0 else x for i, x in enumerate(kv)])
    response = pairs("cache-control", F.concat(F.lit("max-age="), n.cast("string")), "content-type", F.lit("text/html"), "date", at.cast("string"), "last-modified", dated)
    revisit = pairs("content-length", F.lit("0"), "date", at.cast("string"), "vary", F.lit("accept"))
    return seen.select(
        (8 * p + n).alias("record_id"), url.alias("url"), at.alias("at"), F.when(full, "response").otherwise("revisit").alias("kind"), tag.alias("etag"), dated.alias("last_modified"),
        F.when(full, response).otherwise(revisit).alias("headers"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit with its original; the original's payload checksum is joined by record id."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = warc.resolve_revisits(page_captures(pages))
    html = F.coalesce("html", F.lit(""))
    payload = pages.select("page_id", F.explode(F.array(F.lit(0), F.lit(3))).alias("visit"), html.alias("html")).select(
        (8 * F.col("page_id") + F.col("visit")).alias("original_id"), F.sha2(F.concat("html", F.when(F.col("visit") == 3, "<!-- 2 -->").otherwise("")).cast("binary"), 256).alias("payload_sha256")
    )
    headers = "array_join(transform(array_sort(map_entries(headers)), x -> concat(x.key, ': ', x.value)), '\\n')"
    return found.join(payload, "original_id", "left").select(
        "record_id", "url_key", "status", "original_id", F.when(F.col("status") == "resolved", F.col("payload_sha256")).alias("payload_sha256"), F.expr(headers).alias("headers")
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    features = durable(quality.quality_features(docs).drop("text"))
    scored = quality.with_posterior(features, quality.fit_rules(quality.pattern_counts(features)))
    return scored.select("doc_id", *quality.BASE, "base_failed", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file())


def op11_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("quality_lost", "good_lost")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = tokenizer_file("byte_bpe_50k.tiktoken")
    return bpe.encode(_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, decoded="decoded").select(
        "doc_id",
        F.expr("cast(size(ids) AS bigint)").alias("n_tokens"),
        F.expr("sha2(array_join(cast(ids AS array<string>), ' '), 256)").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster(_table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    of_cluster = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.array().cast(f"array<{kind}>"), F.col("cluster") + 1)
    return found.assigned.select(
        "vec_id", "cluster", "distance",
        of_cluster(found.inertia, "long").alias("cluster_inertia"),
        F.lit(sum(found.inertia)).cast("long").alias("inertia"),
        of_cluster(digests, "string").alias("centroid_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_pii": op2_pii,
    "op3_simhash": op3_simhash,
    "op4_substring": op4_substring,
    "op5_decontamination": op5_decontamination,
    "op6_licenses": op6_licenses,
    "op7_sharding": op7_sharding,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_interactions": op11_interactions,
    "op12_bpe": op12_bpe,
    "op13_clustering": op13_clustering,
}
