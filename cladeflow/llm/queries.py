"""Queries of the subpackage and, where SQL can state them, their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladeflow.llm import clusters, leaks, pii, sampling, survivors, tokenizer
from cladeflow.plans.problems import sql_bin, sql_clean, sql_taxon
from cladeflow.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.best_records(table(spark, sf_dir, "bcdm_records"), table(spark, sf_dir, "selection_metrics"))


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(table(spark, sf_dir, "bcdm_records"), table(spark, sf_dir, "selection_metrics"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embedding_bundle")
    return clusters.least_alike(clusters.cluster(rows), rows).withColumnRenamed("id", "faiss_id")


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embedding_bundle")
    return clusters.describe(clusters.cluster(rows), rows)


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.block_sample(sampling.delivered(table(spark, sf_dir, "embedding_bundle")))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_column(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.decode_column(p7_ids(spark, sf_dir)).select("doc_id", "decoded")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), edits=2)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.details(table(spark, sf_dir, "documents")).select("doc_id", "pii_type", "start_at")


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_survivors, p2_found, p2_clusters, p4_sample, p7_ids, p7_decoded, p8_found, p8_proximity, p9_found, p9_redacted)}


def _sql_metric(field: str, low: str, high: str) -> str:
    return f"""m_{field} AS (SELECT record_no, {field} FROM (
        SELECT record_no, {field}, row_number() OVER (PARTITION BY record_no ORDER BY scored_at DESC NULLS LAST, {field}) AS r
        FROM selection_metrics WHERE {field} IS NOT NULL AND NOT isnan({field}::DOUBLE) AND {field} BETWEEN {low} AND {high})
        WHERE r = 1)"""


_SQL_SCORED = f"""{_sql_metric("coverage_rank", "0", "3")}, {_sql_metric("primer_mismatches", "0", "10")},
      {_sql_metric("ambiguity_fraction", "0", "1")},
      s AS (SELECT b.*, coverage_rank::DOUBLE AS coverage_rank, primer_mismatches::DOUBLE AS primer_mismatches, ambiguity_fraction
        FROM (SELECT * REPLACE ({sql_bin("bin_uri")} AS bin_uri) FROM bcdm_records) b
        LEFT JOIN m_coverage_rank USING (record_no) LEFT JOIN m_primer_mismatches USING (record_no)
        LEFT JOIN m_ambiguity_fraction USING (record_no) WHERE bin_uri IS NOT NULL),
      b AS (SELECT bin_uri, n_rows, record_no, coverage_rank, primer_mismatches, ambiguity_fraction FROM (
        SELECT *, count(*) OVER (PARTITION BY bin_uri) AS n_rows, row_number() OVER (PARTITION BY bin_uri ORDER BY
          coverage_rank NULLS LAST, primer_mismatches NULLS LAST, ambiguity_fraction NULLS LAST, record_no) AS r FROM s)
        WHERE r = 1 AND n_rows >= 2)"""


def _sql_survivors() -> str:
    cells = " UNION ALL ".join(
        f"SELECT bin_uri, '{r}' AS field, {sql_taxon(r)} AS value, ingested_at, coverage_rank FROM s" for r in survivors.RANKS
    )
    vote = f"""(CASE coverage_rank WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END) * CAST(pow(2,
        {survivors.HALVINGS} - least({survivors.HALVINGS}, coalesce(floor(greatest(0, floor(epoch(TIMESTAMPTZ '{survivors.AS_OF}+00'))
        - floor(epoch(ingested_at))) / {survivors.HALF_LIFE_DAYS * 86400}), {survivors.HALVINGS}))) AS BIGINT)"""
    picks = ", ".join(f"max(CASE WHEN field = '{r}' THEN value END) AS {r}" for r in survivors.RANKS)
    return f"""WITH {_SQL_SCORED},
      v AS (SELECT bin_uri, field, value, sum({vote}) AS votes, max(ingested_at) AS newest
            FROM ({cells}) WHERE value IS NOT NULL GROUP BY ALL),
      w AS (SELECT *, row_number() OVER (PARTITION BY bin_uri, field ORDER BY votes DESC, newest DESC, value) AS r FROM v)
      SELECT b.*, f.* EXCLUDE (bin_uri) FROM b LEFT JOIN
        (SELECT bin_uri, {picks} FROM w WHERE r = 1 GROUP BY bin_uri) f USING (bin_uri)"""


SQL = {
    "p1_found": f"WITH {_SQL_SCORED} SELECT bin_uri, record_no FROM b",
    "p1_survivors": _sql_survivors(),
    "p2_found": """WITH u AS (SELECT faiss_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embedding_bundle
        WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
          AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
      c AS (SELECT a.faiss_id, min(b.faiss_id) AS cluster_id, count(*) AS n FROM u a JOIN u b
            ON list_cosine_similarity(a.e, b.e) >= 0.86 GROUP BY a.faiss_id)
      SELECT cluster_id, faiss_id FROM c WHERE n >= 2""",
    "p4_sample": f"""WITH i AS (SELECT upper({sql_clean("ids")}) AS id, min(ROW(bundle_no, faiss_id)) AS f FROM embedding_bundle
        WHERE {sql_clean("ids")} IS NOT NULL GROUP BY 1),
      n AS (SELECT id, row_number() OVER (ORDER BY f, id) - 1 AS seq_no FROM i),
      k AS (SELECT DISTINCT seq_no // {sampling.BLOCK} AS block_no FROM n),
      p AS (SELECT block_no, p, row_number() OVER (PARTITION BY block_no ORDER BY
              md5('{sampling.SEED}:' || block_no || ':' || p)) AS r FROM k, range({sampling.BLOCK}) AS t(p))
      SELECT id, seq_no, block_no FROM n JOIN p ON seq_no = block_no * {sampling.BLOCK} + p WHERE r <= {sampling.TAKE}""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS decoded FROM documents",
}
