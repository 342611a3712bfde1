"""The queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm import language, minhash, mixing, packing, quality, secrets, simhash, substrings, toxicity, vectors
from meshlark.llm.common import held_out, table


def op1_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    rows = minhash.edited_fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the other fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    found = language.identify(docs, language.fit(docs.where("not held_out")))
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the least document that near-duplicate links reach from it."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated windows of 35 words."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35).withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels of the other fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    rows = toxicity.labelled_rows(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, rows))
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of near duplicates, its component, and whether it stays."""
    groups = vectors.embedding_groups(table(spark, sf_dir, "embeddings"), least=0.9)
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return groups.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's posterior under the label model, its score and whether it is kept."""
    scored = quality.score_quality(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", F.col("quality_posterior").alias("posterior"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).alias("keep"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in a padded batch of its length bucket."""
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: counts and digest of the base findings, and all spans."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def many(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    rules = F.filter("secrets", lambda s: s["kind"] != "network")
    return found.select("doc_id", many("assign"), many("access"), many("hex"), F.sha2(joined(rules), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    taken = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_fingerprints": op1_minhash_fingerprints,
    "op2_language_id": op2_language_id,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_packing": op8_packing,
    "op9_secret_scan": op9_secret_scan,
    "op10_source_mixing": op10_source_mixing,
}

#: Hash families, fitted models and pseudorandom draws are not for SQL; those queries are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT r, k, array_to_string(w[k:k+34], ' ') AS words FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
        again AS (SELECT r, k FROM win QUALIFY count(*) OVER (PARTITION BY words) > 1),
        gone AS (SELECT DISTINCT r, k + j AS pos FROM again, (SELECT unnest(range(35)) AS j)),
        word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM word ANTI JOIN gone USING (r, pos) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
    """,
    "op6_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        s AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.r <> b.r AND len(a.e) = len(b.e) AND (a.e = b.e OR list_cosine_similarity(a.e, b.e) >= 0.9)),
        reach AS (SELECT r, r AS t FROM v UNION SELECT reach.r, l.b FROM reach JOIN l ON reach.t = l.a),
        c AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.t = v.r GROUP BY reach.r),
        n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
    """,
}
