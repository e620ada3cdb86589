"""Gaussian and spherical descriptions of groups of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions import vectors as V
from cladeflow.operators import representations as R
from cladeflow.session import Scratch


def moment_cells(rows: DataFrame, group: str, vector: str, dimensions: int) -> DataFrame:
    """(grp, i, j, total): sums of products per pair of dimensions (i <= j), sums with i = -1, counts with i = j = -1.

    A task adds up each batch before anything is shuffled, so a group costs a
    fixed number of cells per batch however many rows it has. Unusable vectors
    and null groups are left out.
    """
    i, j = np.triu_indices(dimensions)
    left = np.concatenate([i, np.full(dimensions, -1), [-1]]).astype(np.int32)
    right = np.concatenate([j, np.arange(dimensions), [-1]]).astype(np.int32)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, at in part.groupby("grp").indices.items():
                x = np.stack(part["v"].to_numpy()[at])
                total = np.concatenate([(x.T @ x)[i, j], x.sum(axis=0), [len(x)]])
                yield pd.DataFrame({"grp": name, "i": left, "j": right, "total": total})

    sound = rows.where(F.col(group).isNotNull() & V.usable(F.col(vector), dimensions)).select(F.col(group).cast("string").alias("grp"), V.doubles(F.col(vector)).alias("v"))
    return sound.mapInPandas(run, "grp string, i int, j int, total double").groupBy("grp", "i", "j").agg(F.sum("total").alias("total"))


def covariances(cells: DataFrame) -> DataFrame:
    """(grp, n, i, j, cov): unbiased covariances (i <= j) of groups of at least two rows."""
    n = cells.where("i = -1 AND j = -1").select("grp", F.col("total").cast("bigint").alias("n")).where("n > 1")
    sums = cells.where("i = -1 AND j >= 0")
    products = cells.where("i >= 0").join(n, "grp")
    both = products.join(sums.select("grp", F.col("j").alias("i"), F.col("total").alias("si")), ["grp", "i"]).join(
        sums.select("grp", "j", F.col("total").alias("sj")), ["grp", "j"]
    )
    return both.select("grp", "n", "i", "j", ((F.col("total") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("cov"))


def wasserstein(m1: np.ndarray, f1: np.ndarray, m2: np.ndarray, f2: np.ndarray) -> float:
    """2-Wasserstein distance of Gaussians given by means and covariance factors (covariance = factor @ factor.T)."""
    shared = np.linalg.svd(f1.T @ f2, compute_uv=False).sum()
    return float(np.sqrt(max(0.0, ((m1 - m2) ** 2).sum() + (f1**2).sum() + (f2**2).sum() - 2 * shared)))


def gaussian(total: np.ndarray, dimensions: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, factor) from cells in order of (i, j): count, sums, products."""
    n, sums, products = int(total[0]), total[1 : dimensions + 1], total[dimensions + 1 :]
    cov = np.zeros((dimensions, dimensions))
    cov[np.triu_indices(dimensions)] = products
    cov = cov + np.triu(cov, 1).T - np.outer(sums, sums) / n
    values, axes = np.linalg.eigh(cov / max(1, n - 1))
    return n, sums / n, axes * np.sqrt(np.maximum(values, 0.0)) if n > 1 else np.zeros_like(cov)


def packed_cells(cells: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the cells of each group in order, a fixed number of them."""
    return cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "total"))), lambda x: x["total"]).alias(name))


def gaussian_distances(cells: DataFrame, parents: DataFrame, dimensions: int) -> DataFrame:
    """(grp, parent, n, distance): 2-Wasserstein distance of each group's Gaussian to that of its parent.

    ``parents`` has (grp, parent). A parent's cells are the sums of its groups'
    cells; a group of one row is a point.
    """

    @F.pandas_udf("double")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = ((gaussian(np.asarray(x), dimensions), gaussian(np.asarray(y), dimensions)) for x, y in zip(a, b))
        return pd.Series([wasserstein(x[1], x[2], y[1], y[2]) for x, y in pairs])

    tied = cells.join(parents, "grp")
    upper = tied.groupBy("parent", "i", "j").agg(F.sum("total").alias("total"))
    both = parents.join(packed_cells(cells, "grp", "a"), "grp").join(packed_cells(upper, "parent", "b"), "parent")
    return both.select("grp", "parent", F.col("a")[0].cast("bigint").alias("n"), apart("a", "b").alias("distance"))


def spherical_means(rows: DataFrame, group: str, vector: str, dimensions: int, tolerance: float = 1e-8, rounds: int = 256) -> DataFrame:
    """(group, n, mean): the point of the unit sphere with the least sum of squared arcs to the group's directions.

    Starts at the unit mean and follows the mean tangent, divided by the mean
    curvature along it (at least 1/4), until no group moves by ``tolerance``.
    Groups whose directions cancel out have no row. Each round is one join on
    the group and one map-side combined sum over groups that still move; means
    live in written tables. Raises if ``rounds`` don't suffice.
    """
    scratch = Scratch(rows.sparkSession, "sphere")
    sound = rows.where(F.col(group).isNotNull() & V.usable(F.col(vector), dimensions))
    units = scratch.keep(sound.select(group, V.unit(F.col(vector)).alias("u")))
    start = R.centroids(units, group, "u").where(V.norm(F.col("centroid")) > 1e-12)
    moving = written = scratch.keep(start.select(group, "n", V.unit(F.col("centroid")).alias("mean"), F.lit(1.0).alias("moved")))
    settled = None
    for _ in range(rounds):
        cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(F.col("u"), F.col("mean"))))
        arc = lambda c: F.when(F.abs(c) > 1 - 1e-15, 1.0).otherwise(F.acos(c) / F.sqrt(1 - c * c))
        # Tangent towards u: arc / sin(arc) * (u - cos(arc) * mean); arc / tan(arc) is the curvature, carried as one more number.
        pull = V.bind(cosine, lambda c: V.bind(arc(c), lambda k: F.concat(F.zip_with("u", "mean", lambda a, b: k * (a - c * b)), F.array(k * c))))
        pulls = units.join(moving.select(group, "mean"), group).select(group, pull.alias("t"))
        curved = V.bind(F.greatest(F.lit(0.25), F.element_at("centroid", -1)), lambda h: F.transform(F.slice("centroid", 1, dimensions), lambda x: x / h))
        step = R.centroids(pulls, group, "t").select(group, curved.alias("t"))
        ahead = moving.drop("moved").join(step, group).withColumn("moved", F.least(F.lit(math.pi / 2), V.norm(F.col("t"))))
        ratio = F.coalesce(F.try_divide(F.sin("moved"), V.norm(F.col("t"))), F.lit(1.0))
        turned = V.bind(ratio, lambda r: F.zip_with("mean", "t", lambda a, b: F.cos("moved") * a + r * b))
        following = scratch.keep(ahead.select(group, "n", V.unit(turned).alias("mean"), "moved"))
        still = following.where(F.col("moved") >= tolerance)
        done = following.where(F.col("moved") < tolerance).drop("moved")
        if settled is None:  # the first table holds no settled mean, later ones are read for theirs
            scratch.drop(written)
        settled = done if settled is None else settled.unionByName(done)
        if not still.limit(1).count():
            return settled
        moving = still
    raise ValueError("the means haven't settled")
