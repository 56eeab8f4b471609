"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm import ann, audit, bpe, centroids, embedding_dedup, exact_dedup, hmm, langid, licenses, packing, secrets, simhash, toxicity
from lumenlog.llm.common import read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and raw pages, by one text model; a row has either a doc_id or a page_id."""
    docs, pages = (read_table(spark, sf_dir, t) for t in ("documents", "pages"))
    model = langid.train(docs)
    new = ["language", "posterior", "text_language", "accepted"]
    of_docs = langid.identify_documents(docs, model).select("doc_id", *new)
    of_pages = langid.identify_pages(pages, model).select("page_id", *new)
    return of_docs.unionByName(of_pages, allowMissingColumns=True)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string")))
    return licenses.scan(read_table(spark, sf_dir, "documents")).withColumn("spans", F.array_join(spans, ","))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(read_table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity.with_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(read_table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(read_table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 100 == 0))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return audit.repaired(audit.damaged(rows), rows)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


def centroid_rounds(rounds: int = 10) -> str:
    """The rounds of op13 written out one after the other."""
    near = lambda c: f"""SELECT v.vec_id, v.q, min({{'distance': list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))), 'cluster': c.cluster}}) AS m
FROM v CROSS JOIN {c} c GROUP BY ALL"""  # noqa: E731
    parts = [
        """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, q FROM (SELECT q, sha256('3:' || vec_id) AS h FROM v ORDER BY h LIMIT 8))",
    ]
    for k in range(rounds):
        parts += [
            f"a{k} AS MATERIALIZED ({near(f'c{k}')})",
            f"s{k} AS (SELECT m.cluster AS cluster, i, sum(q[i])::HUGEINT AS s, count(*) AS n FROM a{k} CROSS JOIN range(1, 65) r(i) GROUP BY ALL)",
            f"f{k} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{k} GROUP BY cluster)",
            f"c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(f.q, c.q) AS q FROM c{k} c LEFT JOIN f{k} f ON c.cluster = f.cluster)",
        ]
    return "WITH " + ",\n".join([*parts, f"last AS MATERIALIZED ({near(f'c{rounds}')})"]) + f"""
SELECT vec_id, m.cluster::INT AS cluster, m.distance::BIGINT AS distance, (sum(m.distance) OVER (PARTITION BY m.cluster))::BIGINT AS cluster_inertia,
  (sum(m.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM last JOIN c{rounds} c ON m.cluster = c.cluster"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_licenses": op4_licenses,
    "op5_secrets": op5_secrets,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_hmm": op9_hmm,
    "op10_ann": op10_ann,
    "op11_audit": op11_audit,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL: dict[str, str] = {
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), low AS (SELECT x, min(y) AS y FROM reach GROUP BY x), deg AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.y, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low.y, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON vec_id = low.x LEFT JOIN deg ON vec_id = deg.x""",
    "op12_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""",
    "op13_centroids": centroid_rounds(),
}
