"""Representatives of groups of vectors, exact neighbours, and measures of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.functions import vectors as V

QUERY_BLOCK = 2048


def centroid_cells(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, n, total): decomposable sums per dimension, combined map-side however large a group is."""
    return rows.select(group, F.posexplode(V.doubles(F.col(vector))).alias("dim", "x")).groupBy(group, "dim").agg(
        F.count("x").alias("n"), F.sum("x").alias("total")
    )


def group_sums(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, sums array<double>): as many cells per group as there are dimensions."""
    cells = centroid_cells(rows, group, vector)
    return cells.groupBy(group).agg(
        F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "total"))), lambda c: c["total"]).alias("sums")
    )


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, centroid): mean vector of each group."""
    return group_sums(rows, group, vector).select(group, "n", F.transform("sums", lambda x: x / F.col("n")).alias("centroid"))


def cosine_medoids(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(group, key, n): the row closest to all others by cosine, found from the sum of unit vectors in O(n).

    Ties go to the least key. Zero vectors can't be medoids.
    """
    units = rows.select(group, key, V.unit(F.col(vector)).alias("u")).where("u IS NOT NULL")
    sums = group_sums(units, group, "u")
    scored = units.join(sums, group).select(group, key, "n", F.round(V.dot(F.col("u"), F.col("sums")), 9).alias("score"))
    return scored.groupBy(group).agg(F.max_by(key, F.struct("score", -F.col(key))).alias(key), F.max("n").alias("n"))


def knn(rows: DataFrame, key: str, vector: str, every: int, k: int, dimensions: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, key, rank, similarity): the k rows most alike by cosine to each row whose key is divisible by ``every``.

    The queries are a stated set, taken in blocks of at most ``block`` vectors;
    each task holds one block and a batch and passes on its k best per query.
    Ties go to the least key, a row isn't its own neighbour.
    """
    spark = rows.sparkSession
    sound = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & V.usable(F.col("v"), dimensions)
    )
    asked = sound.where(F.col("id") % every == 0)
    n_blocks = max(1, -(-asked.count() // block))
    found = None
    for b in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).orderBy("id").collect()
        if not part:
            continue
        q = np.array([r.v for r in part])
        shared = spark.sparkContext.broadcast((np.array([r.id for r in part]), q / np.linalg.norm(q, axis=1, keepdims=True)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, unit = shared.value
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
                order = np.argsort(keys, kind="stable")
                keys, x = keys[order], x[order] / np.linalg.norm(x[order], axis=1, keepdims=True)
                sims = np.round(unit @ x.T, 9)
                sims[ids[:, None] == keys[None, :]] = -np.inf
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                rows_ = np.repeat(np.arange(len(ids)), top.shape[1])
                best = sims[rows_, top.ravel()]
                good = np.isfinite(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows_[good]]), pa.array(keys[top.ravel()[good]]), pa.array(best[good])], names=["query", "id", "similarity"]
                )

        hits = sound.mapInArrow(run, "query bigint, id bigint, similarity double")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "query bigint, id bigint, rank int, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "id", "rank", "similarity")


def _closest(shared):
    def closest(column: pd.Series) -> pd.DataFrame:
        names, unit = shared.value
        x = np.stack(column.to_numpy()).astype(np.float64)
        sims = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ unit.T, 9)
        at = np.argmax(sims, axis=1)
        return pd.DataFrame({"similarity": sims[np.arange(len(x)), at], "label": names[at]})

    return closest


def nearest(rows: DataFrame, key: str, vector: str, means: DataFrame, dimensions: int, block: int = 10_000) -> DataFrame:
    """(key, nearest): the label of ``means`` (label, mean) most alike by cosine; ties go to the least label.

    The means are taken in blocks of at most ``block``, each broadcast in turn;
    the best of each block meet per row. Without means there is no row.
    """
    sound = rows.where(V.usable(F.col(vector), dimensions)).select(key, V.doubles(F.col(vector)).alias("_v"))
    n_blocks = max(1, -(-means.count() // block))
    best = None
    for b in range(n_blocks):
        part = sorted((r.label, r.mean) for r in means.where(F.pmod(F.xxhash64("label"), F.lit(n_blocks)) == b).collect())
        if not part:
            continue
        m = np.array([x for _, x in part])
        shared = rows.sparkSession.sparkContext.broadcast((np.array([x for x, _ in part]), m / np.linalg.norm(m, axis=1, keepdims=True)))

        hits = sound.select(key, F.pandas_udf(_closest(shared), "struct<similarity:double,label:bigint>")("_v").alias("_c")).select(key, "_c.*")
        best = hits if best is None else best.unionByName(hits)
    if best is None:
        return rows.select(key, F.lit(None).cast("bigint").alias("nearest")).limit(0)
    return best.groupBy(key).agg(F.max_by("label", F.struct("similarity", -F.col("label"))).alias("nearest"))


def nested_centroids(rows: DataFrame, path: list[str], vector: str) -> DataFrame:
    """(path[0], n, centroid): unit means of the lowest groups, averaged without weights and made unit again level by level up.

    Rows that miss a name of the path are left out.
    """
    named = rows.where(F.forall(F.array(*path), lambda x: x.isNotNull()))
    level = named.select(F.struct(*path).alias("g"), F.col(vector).alias("u"))
    for depth in range(len(path), 0, -1):
        means = centroids(level, "g", "u")
        level = means.select((F.struct(*[F.col(f"g.{c}") for c in path[: depth - 1]]) if depth > 1 else F.col(f"g.{path[0]}")).alias("g"), V.unit(F.col("centroid")).alias("u")) if depth > 1 else means.select(F.col(f"g.{path[0]}").alias(path[0]), "n", V.unit(F.col("centroid")).alias("centroid"))
    return level


def average_rank(value: Column, *within: str) -> Column:
    """Rank with ties averaged, per group of the columns ``within``; for groups of bounded size."""
    part = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    return F.rank().over(part.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*within, value)) - 1) / 2


def pearson(x: Column, y: Column) -> Column:
    """Correlation from plain sums; null where a side is constant."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    top = n * F.sum(x * y) - F.sum(x) * F.sum(y)
    a, b = n * F.sum(x * x) - F.sum(x) * F.sum(x), n * F.sum(y * y) - F.sum(y) * F.sum(y)
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(top, F.sqrt(F.greatest(a * b, F.lit(0.0)))))


def regression(x: Column, y: Column) -> tuple[Column, Column]:
    """Slope and intercept of the least-squares line; null where x is constant or there are fewer than two pairs."""
    sound = (F.count(F.lit(1)) > 1) & (F.min(x) < F.max(x))
    return F.when(sound, F.regr_slope(y, x)), F.when(sound, F.regr_intercept(y, x))


def undefined_reason(x: Column, y: Column) -> Column:
    """Why correlations have no value; null where they have one."""
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(F.count(F.lit(1)) < 2, "fewer_than_two_pairs").when(constant, "constant_distances")


def fit_measures(target: Column, predicted: Column) -> list[Column]:
    """Aggregates of how distances are met: stress, signed and absolute error, 90th percentile, MAPE, scale and Pearson.

    The percentile is exact and holds a group's values at once, so the pairs must
    be a bounded sample.
    """
    e = predicted - target
    scale = F.greatest(F.lit(0.0), F.try_divide(F.sum(target * predicted), F.sum(predicted * predicted)))
    scaled = F.sum(target * target) - 2 * scale * F.sum(target * predicted) + scale * scale * F.sum(predicted * predicted)
    return [
        F.count(F.lit(1)).alias("n_pairs"),
        F.round(F.sqrt(F.try_divide(F.sum(e * e), F.sum(target * target))), 6).alias("stress"),
        F.round(F.avg(e), 6).alias("mean_error"),
        F.round(F.avg(F.abs(e)), 6).alias("mean_abs_error"),
        F.round(F.percentile(F.abs(e), 0.9), 6).alias("p90_abs_error"),
        F.round(F.avg(F.when(target > 0, F.abs(e) / target)) * 100, 6).alias("mape"),
        F.count_if(target == 0).alias("n_zero_targets"),
        F.round(scale, 6).alias("scale"),
        F.round(F.sqrt(F.try_divide(F.greatest(F.lit(0.0), scaled), F.sum(target * target))), 6).alias("scaled_stress"),
        F.round(pearson(target, predicted), 6).alias("pearson"),
    ]


# How two records are related, the code being the position.
RELATIONS = ("same_species", "same_genus", "same_family", "other_family", "unknown")


def relation(known: dict[str, tuple[Column, Column]]) -> Column:
    """The code of RELATIONS for (left, right) names of species, genus and family, null for an unknown one; the species decides first."""
    same = {rank: (a == b) for rank, (a, b) in known.items()}
    return (
        F.when(same["species"], 0)
        .when(same["family"] & same["genus"], 1)
        .when(same["family"] & ~same["genus"], 2)
        .when(~same["family"], 3)
        .otherwise(4)
    )


def first_difference(pairs: dict[str, tuple[Column, Column]], within: str) -> Column:
    """The first rank, from the top, whose names differ; ``within`` if none does. A missing name differs from any other."""
    return F.coalesce(*[F.when(~a.eqNullSafe(b), rank) for rank, (a, b) in pairs.items()], F.lit(within))


def scatter_metrics(pairs: DataFrame, x: str, y: str, masks: int) -> DataFrame:
    """(mask, n_pairs, pearson, spearman, slope, intercept, reason) over every union of relations; of a bounded sample of pairs.

    ``pairs`` has ``relation``; a mask takes the pairs whose relation's bit it
    has. Ranks are average ranks within the union.
    """
    bit = F.call_function("shiftleft", F.lit(1), F.col("relation"))
    chosen = pairs.select(F.col(x).alias("x"), F.col(y).alias("y"), F.explode(F.sequence(F.lit(1), F.lit(masks - 1))).alias("mask"), bit.alias("bit")).where(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    ranked = chosen.withColumn("rx", average_rank(F.col("x"), "mask")).withColumn("ry", average_rank(F.col("y"), "mask"))
    a, b = F.col("x"), F.col("y")
    slope, intercept = regression(a, b)
    measured = ranked.groupBy("mask").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.round(pearson(a, b), 6).alias("pearson"), F.round(pearson(F.col("rx"), F.col("ry")), 6).alias("spearman"),
        F.round(slope, 6).alias("slope"), F.round(intercept, 6).alias("intercept"), undefined_reason(a, b).alias("reason"),
    )
    every = pairs.sparkSession.range(masks).select(F.col("id").cast("int").alias("mask"))
    return every.join(measured, "mask", "left").select(
        "mask", F.coalesce("n_pairs", F.lit(0).cast("bigint")).alias("n_pairs"), "pearson", "spearman", "slope", "intercept",
        F.when(F.col("n_pairs").isNull(), "fewer_than_two_pairs").otherwise(F.col("reason")).alias("reason"),
    )
