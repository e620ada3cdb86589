"""Queries of the general problems (3, 5 and 6) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.functions.text import bin_name, taxon_name
from cladeflow.operators import hierarchy, hotkeys, rejects
from cladeflow.session import table

SHARE = 0.02
LENGTH_BINS = 16  # lengths of barcodes take two passes or three


def _taxon_keys():
    return {"family": taxon_name(F.col("family")), "genus": taxon_name(F.col("genus")), "bin_uri": bin_name(F.col("bin_uri"))}


def _length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "bcdm_records").select("family", "genus", "bin_uri", "nuc")
    return hotkeys.key_quantiles(records, _taxon_keys(), F.length("nuc"), bins=LENGTH_BINS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "bcdm_records").count()
    return hotkeys.heavy_keys(_length_profile(spark, sf_dir), total, SHARE).select("field_name", "key_text")


def p3_length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _length_profile(spark, sf_dir)


def p3_ingest_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "bcdm_records").select("family", "genus", "bin_uri", "ingested_at")
    return hotkeys.key_quantiles(records, _taxon_keys(), F.unix_micros("ingested_at"), probs=(0.1, 0.5, 0.9))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy_faults(table(spark, sf_dir, "node_lengths"))


def p5_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy_status(table(spark, sf_dir, "node_lengths"))


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = hierarchy.hierarchy_paths(table(spark, sf_dir, "node_lengths"))
    return paths.select("tree", "node_id", "root_id", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy_paths(table(spark, sf_dir, "node_lengths")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.failed_rows(rejects.parse_lines(table(spark, sf_dir, "bcdm_raw"))).select("line_no", "reason")


def p6_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.sound_rows(rejects.parse_lines(table(spark, sf_dir, "bcdm_raw")))


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_length_quantiles, p3_ingest_quantiles, p5_found, p5_status, p5_paths, p5_descendants, p6_found, p6_rows)
}

# SQL twins. Blanks are spelled out, as RE2's \s knows ASCII only.
BLANKS = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
MISSING = "('', 'none', 'null', 'na', 'n/a', 'nan', 'unknown', '-')"


def sql_clean(cell: str) -> str:
    text = f"trim(regexp_replace({cell}, '{BLANKS}', ' ', 'g'))"
    return f"CASE WHEN lower({text}) NOT IN {MISSING} THEN {text} END"


def sql_taxon(cell: str) -> str:
    text = sql_clean(cell)
    return f"(upper(substr({text}, 1, 1)) || lower(substr({text}, 2)))"


def sql_bin(cell: str) -> str:
    rest = rf"regexp_replace(regexp_replace(upper({cell}), '[^\p{{L}}\p{{N}}]', '', 'g'), '^BOLD', '')"
    return f"CASE WHEN regexp_full_match({rest}, '[A-Z]{{3}}[0-9]{{4}}') THEN 'BOLD:' || {rest} END"


def _sql_long(value: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS field_name, {key} AS key_text, {value} AS v FROM bcdm_records"
        for name, key in (("family", sql_taxon("family")), ("genus", sql_taxon("genus")), ("bin_uri", sql_bin("bin_uri")))
    )
    return f"l AS (SELECT * FROM ({parts}) WHERE key_text IS NOT NULL)"


def _sql_quantiles(value: str, percents: tuple[int, ...]) -> str:
    picks = ", ".join(
        f"max(CASE WHEN r = greatest(1, CAST(ceil({p / 100} * n_values) AS BIGINT)) THEN v END) AS q{p:02d}" for p in percents
    )
    return f"""WITH {_sql_long(value)},
      r AS (SELECT *, row_number() OVER (PARTITION BY field_name, key_text ORDER BY v NULLS LAST) AS r,
                   count(v) OVER (PARTITION BY field_name, key_text) AS n_values FROM l)
      SELECT field_name, key_text, count(*) AS n_rows, max(n_values) AS n_values, {picks}
      FROM r GROUP BY field_name, key_text"""


_SQL_WALK = """WITH RECURSIVE nodes AS (
        SELECT tree, node_id, arg_max(coalesce(parent_id, -1), written_at) AS parent_id FROM node_lengths GROUP BY tree, node_id),
      n AS (SELECT c.tree, c.node_id, c.parent_id, p.node_id IS NOT NULL AS more
            FROM nodes c LEFT JOIN nodes p ON p.tree = c.tree AND p.node_id = c.parent_id),
      w AS (SELECT tree, node_id, parent_id AS next_id, more, 0 AS steps, [node_id] AS path FROM n
            UNION ALL
            SELECT w.tree, w.node_id, n.parent_id, n.more, w.steps + 1, list_prepend(w.next_id, w.path)
            FROM w JOIN n ON n.tree = w.tree AND n.node_id = w.next_id
            WHERE NOT list_contains(w.path, w.next_id)),
      s AS (SELECT *, CASE WHEN next_id = -1 THEN 'rooted' WHEN NOT more THEN 'lost'
                           WHEN next_id = node_id THEN 'cycle' ELSE 'below_cycle' END AS fate
            FROM w WHERE NOT more OR list_contains(path, next_id))"""

_CELL = '("([^"]|"")*"|[^"\\t][^\\t]*|)'
_SQL_LINES = f"""WITH l AS (SELECT line_no, raw_line, regexp_replace(coalesce(raw_line, ''), '\\r$', '') AS line FROM bcdm_raw),
      c AS (SELECT *, regexp_full_match(line, '{_CELL}(\\t{_CELL})*') AS sound,
              regexp_extract_all(chr(9) || line, '\\t{_CELL}', 1) AS raw_cells FROM l),
      d AS (SELECT *, list_transform(raw_cells, lambda x: CASE WHEN starts_with(x, '"')
              THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS cells FROM c)"""


def _sql_reason() -> str:
    return f"""e AS (SELECT *, CASE WHEN NOT sound THEN 'quoting'
        WHEN raw_line IS NULL OR len(cells) <> 15 THEN 'columns'
        WHEN NOT coalesce(regexp_full_match({sql_clean("cells[2]")}, '(?i:BOLD):[A-Za-z]{{3}}[0-9]{{4}}'), true)
          OR NOT coalesce(regexp_full_match({sql_clean("cells[12]")}, '[A-Z][a-z]{{2,}}( [A-Za-z0-9.\\-]+){{1,5}}'), true)
        THEN 'value' END AS reason FROM d)"""


SQL = {
    "p3_found": f"""WITH {_sql_long("0")} SELECT field_name, key_text FROM l GROUP BY ALL
        HAVING count(*) >= {SHARE} * (SELECT count(*) FROM bcdm_records)""",
    "p3_length_quantiles": _sql_quantiles("CAST(length(nuc) AS BIGINT)", (25, 50, 75)),
    "p3_ingest_quantiles": _sql_quantiles("epoch_us(ingested_at)", (10, 50, 90)),
    "p5_found": f"{_SQL_WALK} SELECT tree, node_id, fate AS fault FROM s WHERE fate <> 'rooted'",
    "p5_status": f"""{_SQL_WALK} SELECT tree, node_id, fate, CASE WHEN fate = 'rooted' THEN path[1] END AS root_id,
        CASE WHEN fate = 'rooted' THEN CAST(steps AS BIGINT) END AS depth FROM s""",
    "p5_paths": f"""{_SQL_WALK} SELECT tree, node_id, path[1] AS root_id, CAST(steps AS BIGINT) AS depth,
        array_to_string(path, '/') AS path FROM s WHERE fate = 'rooted'""",
    "p5_descendants": f"""{_SQL_WALK} SELECT tree, path[i] AS ancestor_id, node_id AS descendant_id, CAST(steps - i + 1 AS BIGINT) AS distance
        FROM (SELECT *, unnest(range(1, steps + 1)) AS i FROM s WHERE fate = 'rooted')""",
    "p6_found": f"{_SQL_LINES}, {_sql_reason()} SELECT line_no, reason FROM e WHERE reason IS NOT NULL",
    "p6_rows": f"{_SQL_LINES}, {_sql_reason()} SELECT line_no, "
    + ", ".join(f'{sql_clean(f"cells[{i + 1}]")} AS "{n}"' for i, n in enumerate(rejects.DUMP_COLUMNS))
    + " FROM e WHERE reason IS NULL",
}
