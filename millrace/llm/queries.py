"""Registered queries of the training-data operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann, conversations, decontaminate, filter_audit, jaccard_join, langid, lines, mixing, passages, repeats, secrets, sharding, simhash


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_documents(spark, sf_dir), length=200, keep=["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.near_passages(_documents(spark, sf_dir), least_words=50, similarity=0.8)
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    return out.withColumn("spans", spans)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])


def op5_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    docs = _documents(spark, sf_dir).select("doc_id", "text", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("bytes").alias("law"))
    out = sharding.shard_texts(docs, 8, keep=["doc_id", "size", "text_crc32", "law"])
    return out.withColumn("grown_shard", F.lit(None).cast("int"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_documents(spark, sf_dir), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), width=4, radius=4)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    docs = _documents(spark, sf_dir).withColumn("held_out", held_out)
    model = langid.fit(docs, ~F.col("held_out"))
    return langid.identify(docs, model, keep=["doc_id", "held_out"])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a source is an owner; what it holds in one language, a repository of its own
    docs = _documents(spark, sf_dir).withColumn("repository", F.concat_ws("/", F.coalesce("source", F.lit("~")), F.coalesce("lang", F.lit("~"))))
    found = secrets.scan(docs, repository="repository", keep=["doc_id"])
    base = F.filter("secret_spans", lambda s: s["base"])
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    number = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[number(k) for k in secrets.KINDS],
        F.sha2(F.concat_ws(",", F.transform(base, label)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("secret_spans", label)).alias("spans"),
        F.size(F.filter("secret_spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.concat_ws(",", F.transform("secret_spans", lambda s: F.concat_ws("/", s["n_owners"].cast("string"), s["n_repositories"].cast("string")))).alias("owners"),
    )


#: Equal shares for all sources but the crawl-like first one, which gets three.
MIX_WEIGHTS = {"src0": 3.0}


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(_documents(spark, sf_dir), MIX_WEIGHTS).select("doc_id", "source", "copies", "copy_no", "mix_key", "text")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(_documents(spark, sf_dir), width=4, percent=85)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair_reports(conversations.damage(given), ids=given)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_repeats, op2_nearest, op3_passages, op4_decontaminate, op5_lpt_shards, op6_line_dedup, op7_simhash, op8_language, op9_secrets, op10_poisson_mix, op11_jaccard_join, op12_conversation_repair, op13_filter_audit)}

SQL: dict[str, str] = {
    "op10_poisson_mix": """
WITH sizes AS (SELECT source, CAST(sum(coalesce(strlen(text), 0) + 1) AS DOUBLE) AS bytes, CASE WHEN source = 'src0' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM documents GROUP BY source),
totals AS (SELECT sum(bytes) AS all_bytes, sum(weight) AS all_weight FROM sizes),
rates AS (SELECT source, weight / all_weight * all_bytes * 1.0::DOUBLE / bytes AS rate FROM sizes, totals),
terms AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, range(0, 400) r(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT doc_id, source, text, CAST('0x' || substr(md5('count-17#' || coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (SELECT d.doc_id, d.source, d.text, count(*) FILTER (WHERE c.c <= d.u) AS copies FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, source, CAST(copies AS INTEGER) AS copies, CAST(copy_no AS INTEGER) AS copy_no,
       CAST('0x' || substr(md5('order-17#' || coalesce(CAST(doc_id AS VARCHAR), '~') || '#' || CAST(copy_no AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS mix_key, text
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy_no FROM counted)
""",
    "op13_filter_audit": r"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * list_unique(w) < 50 * len(w) THEN 'B' ELSE '' END
       || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
       || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS mask FROM words d LEFT JOIN told USING (doc_id)),
masks AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || d.c || e.c || f.c AS filter_order FROM letters a, letters b, letters d, letters e, letters f WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS c FROM orders, range(1, 6) s(step)),
cells AS (SELECT m.*, filter_order, step, c, contains(mask, c) AS failing, length(translate(filter_order[1:step - 1], mask, '')) < step - 1 AS gone FROM masks m, steps),
counted AS (SELECT part, filter_order, step, c, sum(n) FILTER (WHERE NOT gone AND NOT failing) AS kept, sum(n) FILTER (WHERE failing AND NOT gone) AS removed, sum(n) FILTER (WHERE failing AND gone) AS redundant,
       sum(n) FILTER (WHERE mask = c) AS unique_fails, sum(good) FILTER (WHERE failing AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE failing AND NOT gone) AS toxic_lost FROM cells GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM counted
""",
}
