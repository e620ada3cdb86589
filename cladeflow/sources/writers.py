"""Writers of selected rows, sequences and partitioned tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from cladeflow.functions.seq import wrap

ROWS_PER_GROUP = 16_384


def write_rows(rows: DataFrame, path: str) -> None:
    """Tab-separated with a header."""
    rows.write.mode("errorifexists").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def write_fasta(rows: DataFrame, path: str, header: str = "header", sequence: str = "sequence") -> None:
    """One record per row, sequences in lines of 80 letters; rows without sequence are left out."""
    record = F.concat(F.lit(">"), F.col(header), F.lit("\n"), wrap(F.col(sequence)))
    rows.where(F.length(sequence) > 0).select(record).write.mode("errorifexists").text(path)


def write_by_key(rows: DataFrame, path: str, key: str, salts: int = 1) -> None:
    """Parquet partitioned by a key; with more ``salts`` a hot key's rows are written by that many tasks."""
    spread = rows.withColumn("_s", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    spread.repartition(key, "_s").drop("_s").write.mode("errorifexists").option("compression", "zstd").partitionBy(key).parquet(path)


def write_newick(tokens: DataFrame, path: str) -> None:
    """Pieces of ``trees.newick_tokens`` as text, one per line; part files in order of their names make up the trees."""
    ordered = tokens.repartitionByRange("tree", "root_id", "key").sortWithinPartitions("tree", "root_id", "key")
    ordered.select("token").write.mode("errorifexists").text(path)


def _files(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> dict[str, int]:
    """Writes several tables so that a reader of ``path`` finds all of them or nothing; returns their row counts.

    They are written beside ``path`` in the given order, and the folder is moved
    into place at the end; a failure takes everything back. Rows written are
    counted on the way and compared with the rows read back. An existing path raises.
    """
    target, files = _files(spark, path)
    if files.exists(target):
        raise FileExistsError(path)
    staging, _ = _files(spark, f"{path.rstrip('/')}.staging-{uuid.uuid4().hex[:8]}")
    counts = {}
    try:
        for name, table in tables.items():
            seen = Observation()
            table.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").option("parquet.block.row.count.limit", ROWS_PER_GROUP).parquet(f"{staging}/{name}")
            counts[name] = seen.get["n"]
            reconcile(counts[name], spark.read.schema(table.schema).parquet(f"{staging}/{name}"), name)
        if not files.rename(staging, target):
            raise OSError(f"could not move the tables to {path}")
    except BaseException:
        files.delete(staging, True)
        raise
    return counts


def reconcile(selected: int, written: DataFrame, name: str = "rows") -> None:
    """Raises unless as many rows were written as were selected."""
    n = written.count()
    if n != selected:
        raise ValueError(f"{name}: {selected} rows selected, {n} written")


def flat_cells(rows: DataFrame) -> DataFrame:
    """The rows with arrays, maps and structs as JSON text, so that they fit a table of cells."""
    nested = (ArrayType, MapType, StructType)
    return rows.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in rows.schema.fields])


def write_report(spark: SparkSession, path: str, summary: dict, tables: dict[str, DataFrame]) -> None:
    """A report: ``summary`` as one JSON line and each table as CSV with a header, nested cells as JSON, summary last."""
    for name, table in tables.items():
        flat_cells(table).write.mode("errorifexists").option("header", True).csv(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/summary")


def merge_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of several written shards, columns matched by name, missing ones null."""
    merged = spark.read.parquet(paths[0])
    for path in paths[1:]:
        merged = merged.unionByName(spark.read.parquet(path), allowMissingColumns=True)
    return merged


def append_missing(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key isn't written at ``path`` yet and returns all that is there, so that an interrupted run goes on."""
    spark = rows.sparkSession
    target, files = _files(spark, path)
    done = spark.read.schema(rows.schema).parquet(path) if files.exists(target) else None
    fresh = rows if done is None else rows.join(done.select(key), key, "left_anti").select(*rows.columns)
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
