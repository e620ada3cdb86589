"""Trees over taxa by neighbour joining: a numpy kernel per taxon, whose fan-out is bounded, grafted together as edge tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.functions import vectors as V
from cladeflow.operators import hierarchy, shapes, trees
from cladeflow.operators import representations as R
from cladeflow.session import Scratch

MAX_CHILDREN = 500
DIVIDER = "divider-1"
# What represents a taxon: the mean of its records, the record closest to all, the mean weighted by the tree below it,
# their Gaussian, and the point of the sphere closest to all. Distances are of cosine, of Gaussians by Wasserstein.
METHODS = ("centroid", "medoid", "weighted", "wasserstein", "frechet")
EDGES = "taxon string, parent string, child string, length double, clamped int, share double"


def neighbour_joining(d: np.ndarray) -> tuple[list[tuple[int, int, float]], int]:
    """(parent, child, length) edges of an unrooted tree and the number of negative lengths set to 0.

    Tips are 0..n-1, joints follow; two remaining nodes hang on the last joint.
    """
    n = len(d)
    if n == 1:
        return [], 0
    dist = np.array(d, float)
    nodes, edges, clamped, new = list(range(n)), [], 0, n

    def add(parent: int, child: int, length: float) -> None:
        nonlocal clamped
        clamped += length < 0
        edges.append((parent, child, max(0.0, float(length))))

    while len(nodes) > 3:
        m = len(nodes)
        total = dist.sum(axis=1)
        q = (m - 2) * dist - total[:, None] - total[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(np.unravel_index(np.argmin(q), q.shape))
        half = dist[i, j] / 2 + (total[i] - total[j]) / (2 * (m - 2))
        add(new, nodes[i], half)
        add(new, nodes[j], dist[i, j] - half)
        row = (dist[i] + dist[j] - dist[i, j]) / 2
        keep = [x for x in range(m) if x not in (i, j)]
        grown = np.zeros((m - 1, m - 1))
        grown[:-1, :-1] = dist[np.ix_(keep, keep)]
        grown[-1, :-1] = grown[:-1, -1] = row[keep]
        dist, nodes, new = grown, [*[nodes[x] for x in keep], new], new + 1
    if len(nodes) == 3:
        a, b, c = dist[0, 1], dist[0, 2], dist[1, 2]
        for node, length in zip(nodes, ((a + b - c) / 2, (a + c - b) / 2, (b + c - a) / 2)):
            add(new, node, length)
    else:
        add(new, nodes[0], dist[0, 1] / 2)
        add(new, nodes[1], dist[0, 1] / 2)
    return edges, clamped


def rooted_in_middle(n: int, edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The edges of a connector over tips 0..n-1 with the root (-1) in the middle of its longest way between tips; as given if all are 0.

    Nodes left with one child are suppressed.
    """
    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))

    def ways(start: int) -> tuple[dict[int, float], dict[int, int]]:
        far, came, todo = {start: 0.0}, {start: -1}, [start]
        while todo:
            x = todo.pop()
            for y, w in near[x]:
                if y not in far:
                    far[y], came[y] = far[x] + w, x
                    todo.append(y)
        return far, came

    far, _ = ways(0)
    one = max(range(n), key=lambda t: (far[t], -t))
    far, came = ways(one)
    two = max(range(n), key=lambda t: (far[t], -t))
    half = far[two] / 2
    if half > 0:
        low = two
        while far[came[low]] > half:
            low = came[low]
        up = came[low]
        offset = far[low] - half
        near[low] = [(y, w) for y, w in near[low] if y != up] + [(-1, offset)]
        near[up] = [(y, w) for y, w in near[up] if y != low] + [(-1, far[low] - far[up] - offset)]
        near[-1] = [(low, offset), (up, far[low] - far[up] - offset)]
        top = -1
    else:
        top = edges[-1][0]
    out, todo = [], [(top, None, top, 0.0)]
    while todo:
        x, came_from, parent, carried = todo.pop()
        below = [(y, w) for y, w in near[x] if y != came_from]
        if x != top and len(below) == 1 and x >= n:
            todo.append((below[0][0], x, parent, carried + below[0][1]))
            continue
        if x != top:
            out.append((parent, x, carried))
        todo += [(y, x, x, w) for y, w in below]
    return [(-1 if p == top else p, c, w) for p, c, w in out]


def distances(x: np.ndarray, method: str, dimensions: int) -> np.ndarray:
    """Pairwise distances of representations: cosine within 0 and 2, or 2-Wasserstein of Gaussians given by their cells."""
    if method != "wasserstein":
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = np.clip(1 - unit @ unit.T, 0, 2)
        np.fill_diagonal(d, 0)
        return d
    if x.shape[1] == dimensions:  # records are points
        return np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    g = [shapes.gaussian(row, dimensions) for row in x]
    d = np.zeros((len(x), len(x)))
    for i in range(len(x)):
        for j in range(i):
            d[i, j] = d[j, i] = shapes.wasserstein(g[i][1], g[i][2], g[j][1], g[j][2])
    return d


def connect(children: DataFrame, method: str, dimensions: int, style: str = "midpoint") -> DataFrame:
    """(taxon, parent, child, length, clamped, share): a connector of the children of each taxon, of (taxon, child, n, rep) rows.

    The taxon itself is the root, joints are ``<taxon>#<number>``. ``midpoint``
    roots each connector in its middle, with a lone child at length 0; ``plain``
    keeps the last joint as root and gives two children half their distance,
    0.001 at least. ``clamped`` counts a connector's negative lengths set to 0,
    on its first edge. ``share`` is, at a child, the sum of length by records
    below over the edges down to it.
    """

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("child")
        names, label, n = part["child"].tolist(), part["taxon"].iloc[0], len(part)
        clamped = 0
        if n == 1:
            edges = [(-1, 0, 0.0)]
        else:
            d = distances(np.stack(part["rep"].to_numpy()), method, dimensions)
            if style == "plain" and n == 2:
                edges = [(-1, i, max(0.001, d[0, 1] / 2)) for i in (0, 1)]
            else:
                found, clamped = neighbour_joining(d)
                last = found[-1][0]
                edges = rooted_in_middle(n, found) if style == "midpoint" else [(-1 if p == last else p, c, w) for p, c, w in found]
        up = {c: (p, w) for p, c, w in edges}
        records = dict.fromkeys(up, 0)
        for i, count in enumerate(part["n"].tolist()):
            at = i
            while at != -1:
                records[at] += count
                at = up[at][0]
        shares = []
        for _, c, _ in edges:
            at, total = c, 0.0
            while at != -1:
                total += up[at][1] / records[at]
                at = up[at][0]
            shares.append(total)
        name = lambda i: label if i == -1 else names[i] if i < n else f"{label}#{i - n}"
        rows = [(label, name(p), name(c), w, clamped if k == 0 else 0, s) for k, ((p, c, w), s) in enumerate(zip(edges, shares))]
        return pd.DataFrame(rows, columns=["taxon", "parent", "child", "length", "clamped", "share"])

    return children.select("taxon", "child", "n", "rep").groupBy("taxon").applyInPandas(build, EDGES)


def divide(children: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(taxon, child, part, …): children of taxa with more than ``most`` of them are given parts of about half as many, alike ones together.

    They are cut at quantiles of their projection on a fixed direction, and by a
    hash where too many project alike, so that no task gets a whole large taxon.
    ``part`` is null elsewhere.
    """
    sizes = children.groupBy("taxon").agg(F.count(F.lit(1)).alias("_n"))
    if sizes.where(F.col("_n") > most).isEmpty():
        return children.withColumn("part", F.lit(None).cast("string"))
    angle = F.aggregate(F.zip_with("mean", F.sequence(F.lit(1), F.size("mean")), lambda x, i: x * F.sin(i * i * 1.7)), F.lit(0.0), lambda a, x: a + x) / V.norm(F.col("mean"))
    shown = scratch.keep(children.join(sizes, "taxon").withColumn("_t", angle))
    large = shown.where(F.col("_n") > most)
    grid = [k / 64 for k in range(1, 64)]
    cuts = large.groupBy("taxon").agg(F.percentile_approx("_t", grid, 10_000).alias("_cuts"))
    placed = large.join(cuts, "taxon")
    wanted = F.least(F.lit(64), F.ceil(F.col("_n") * 2 / most))
    bucket = F.floor(F.size(F.filter("_cuts", lambda c: c < F.col("_t"))) * wanted / 64)
    placed = scratch.keep(placed.withColumn("_b", bucket).drop("_cuts"))
    full = placed.groupBy("taxon", "_b").agg(F.ceil(F.count(F.lit(1)) / most).alias("_pieces"))
    piece = F.pmod(F.xxhash64("child"), F.col("_pieces"))
    named = placed.join(full, ["taxon", "_b"]).withColumn("part", F.concat("taxon", F.lit("#p"), F.col("_b").cast("string"), F.lit("."), piece.cast("string")))
    small = shown.where(F.col("_n") <= most).withColumn("part", F.lit(None).cast("string"))
    return small.drop("_n", "_t").unionByName(named.drop("_n", "_t", "_b", "_pieces"))


def taxon_tree(
    rows: DataFrame, key: str, ranks: list[str], vector: str, dimensions: int, method: str = "centroid",
    max_children: int = MAX_CHILDREN, style: str = "midpoint", root: str = "root",
) -> DataFrame:
    """(rank, taxon, parent, child, length, clamped): one tree from the root over all ranks down to the records.

    Taxa are named by their path below ``root``, bars in names become slashes.
    A taxon is represented by all its records (``METHODS``); in style ``plain``
    by the unit mean of its children's. Children are joined by neighbour joining
    of their representations' distances, and the connectors share the taxa's
    names, so grafting is a union. Children beyond ``max_children`` are joined in
    parts first, then the parts. Rows that miss a rank or a usable vector are
    left out; with ranks cut off at the top the tree starts lower down.
    """
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    scratch = Scratch(rows.sparkSession, "taxa")
    names = [F.translate(F.col(r), "|", "/") for r in ranks]
    named = rows.where(F.forall(F.array(*ranks), lambda r: r.isNotNull()) & F.col(key).isNotNull() & V.usable(F.col(vector), dimensions))
    records = scratch.keep(named.select(F.concat_ws("|", F.lit(root), *names).alias("path"), F.col(key).cast("string").alias("child"), V.doubles(F.col(vector)).alias("mean")))
    v = F.col("mean")
    level = records.select(F.col("path").alias("taxon"), "child", F.lit(1).cast("bigint").alias("n"), (V.unit(v) if style == "plain" else v).alias("mean"), v.alias("total"), F.transform(v, lambda x: F.lit(0.0)).alias("shared"), F.lit(0.0).alias("share_sum"))
    tree = None
    for depth in range(len(ranks), -1, -1):
        rank = ranks[depth] if depth < len(ranks) else "record"
        divided = divide(level, max_children, scratch)
        steps = [("part", "child")] if "#p" and not divided.where("part IS NOT NULL").isEmpty() else []
        for what in [*(s[0] for s in steps), "taxon"]:
            if what == "part":
                inside = divided.where("part IS NOT NULL").withColumn("taxon", F.col("part")).drop("part")
                edges = scratch.keep(connect(_represented(inside, records, method, depth, True), method, dimensions, style))
                parts = _summed(inside, edges, style, dimensions).join(divided.select(F.col("part").alias("child"), F.col("taxon").alias("up")).distinct(), "child").withColumnRenamed("up", "taxon")
                level = divided.where("part IS NULL").drop("part").unionByName(parts.select(*[c for c in divided.columns if c != "part"]))
            else:
                level = scratch.keep(level)
                edges = scratch.keep(connect(_represented(level, records, method, depth, False), method, dimensions, style))
            piece = edges.select(F.lit(rank).alias("rank"), "taxon", "parent", "child", "length", "clamped")
            tree = piece if tree is None else tree.unionByName(piece)
        if depth:
            up = _summed(level, edges, style, dimensions)
            level = up.withColumn("taxon", F.substring_index("child", "|", depth))
    return tree


def _represented(level: DataFrame, records: DataFrame, method: str, depth: int, parts: bool) -> DataFrame:
    """(taxon, child, n, rep) of a level's children. Records and parts of a divided taxon are represented by their mean."""
    mean = level.select("taxon", "child", "n", F.col("mean").alias("rep"))
    if method == "centroid" or level.where(F.col("child").contains("|")).isEmpty():
        return mean
    if method == "weighted":
        weighted = F.transform("shared", lambda x: x / F.col("share_sum"))
        return level.select("taxon", "child", "n", F.when(F.col("share_sum") > 0, weighted).otherwise(F.col("mean")).alias("rep"))
    lower = records.select(F.substring_index("path", "|", depth + 2).alias("child"), F.col("child").alias("record"), "mean")
    if method == "medoid":
        found = R.cosine_medoids(lower.withColumn("_k", F.xxhash64("record")), "child", "_k", "mean").select("child", "_k")
        own = lower.withColumn("_k", F.xxhash64("record")).join(found, ["child", "_k"]).groupBy("child").agg(F.min_by("mean", "record").alias("own"))
    elif method == "frechet":
        own = shapes.spherical_means(lower, "child", "mean", len(records.first()["mean"])).select("child", F.col("mean").alias("own"))
    else:
        cells = shapes.moment_cells(lower, "child", "mean", len(records.first()["mean"]))
        own = shapes.packed_cells(cells, "grp", "own").withColumnRenamed("grp", "child")
    return mean.join(own, "child", "left").select("taxon", "child", "n", F.coalesce("own", "rep").alias("rep"))


def _summed(level: DataFrame, edges: DataFrame, style: str, dimensions: int) -> DataFrame:
    """(child, n, mean, total, shared, share_sum) of each taxon of a level, from its children's and the shares its connector gives them.

    A record's raw weight in a taxon's tree is that in the child's tree plus the
    child's share, so sums of weights and weighted vectors go up level by level.
    """
    shared = level.join(edges.select("taxon", "child", "share"), ["taxon", "child"])
    cells = shared.select(
        "taxon", "n", (F.col("share_sum") + F.col("share") * F.col("n")).alias("w"),
        F.posexplode(F.arrays_zip("total", F.zip_with("shared", "total", lambda s, t: s + F.col("share") * t).alias("heavy"), "mean")).alias("dim", "c"),
    )
    added = cells.groupBy("taxon", "dim").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("c.total").alias("t"), F.sum("c.heavy").alias("s"), F.avg("c.mean").alias("m")
    )
    packed = added.groupBy("taxon").agg(F.max("n").alias("n"), F.max("w").alias("share_sum"), F.array_sort(F.collect_list(F.struct("dim", "t", "s", "m"))).alias("c"))
    mean = V.unit(F.transform("c", lambda x: x["m"])) if style == "plain" else F.transform("c", lambda x: x["t"] / F.col("n"))
    return packed.select(
        F.col("taxon").alias("child"), "n", mean.alias("mean"), F.transform("c", lambda x: x["t"]).alias("total"), F.transform("c", lambda x: x["s"]).alias("shared"), "share_sum"
    )


def spherical_kmeans(rows: DataFrame, key: str, vector: str, dimensions: int, k: int, rounds: int = 20, seed: str = "means-1") -> tuple[DataFrame, DataFrame]:
    """((key, cluster), (cluster, mean)): unit means of ``k`` clusters, started from the vectors of the least hashes of their keys.

    Ends when no row changes its cluster or after ``rounds``. Clusters that lose
    all their rows go.
    """
    scratch = Scratch(rows.sparkSession, "kmeans")
    units = scratch.keep(rows.where(V.usable(F.col(vector), dimensions)).select(F.col(key).alias("key"), V.unit(F.col(vector)).alias("u")))
    first = units.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("key").cast("string"))), "key").limit(k)
    means = scratch.keep(first.select(F.col("key").cast("bigint").alias("label"), F.col("u").alias("mean")))
    given = None
    for _ in range(rounds):
        closest = scratch.keep(R.nearest(units, "key", "u", means, dimensions))
        changed = given is None or not closest.join(given, ["key", "nearest"], "left_anti").isEmpty()
        given = closest
        means = scratch.keep(R.centroids(units.join(given, "key"), "nearest", "u").select(F.col("nearest").alias("label"), V.unit(F.col("centroid")).alias("mean")))
        if not changed:
            break
    return given.select(F.col("key").alias(key), F.col("nearest").alias("cluster")), means.withColumnRenamed("label", "cluster")


def unsupervised_tree(rows: DataFrame, key: str, vector: str, dimensions: int, k: int, rounds: int = 20) -> DataFrame:
    """``taxon_tree`` in style ``plain`` over the clusters of ``spherical_kmeans`` instead of taxa."""
    labels, _ = spherical_kmeans(rows, key, vector, dimensions, k, rounds)
    named = rows.join(labels, key).withColumn("cluster", F.concat(F.lit("Cluster_"), F.col("cluster").cast("string")))
    return taxon_tree(named, key, ["cluster"], vector, dimensions, "centroid", style="plain")


def as_nodes(edges: DataFrame, name: str) -> DataFrame:
    """(tree, node_id, parent_id, label, length) of an edge table, nodes numbered by a 62-bit hash of their names; lengths below 0 become 0."""
    number = lambda c: F.shiftrightunsigned(F.xxhash64(c), 2)
    own = edges.select(F.lit(name).alias("tree"), number("child").alias("node_id"), number("parent").alias("parent_id"), F.col("child").alias("label"), F.greatest(F.lit(0.0), "length").alias("length"))
    top = edges.select(F.col("parent").alias("child")).distinct().join(edges.select("child"), "child", "left_anti")
    return own.unionByName(top.select(F.lit(name).alias("tree"), number("child").alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"), F.col("child").alias("label"), F.lit(0.0).alias("length")))


def measured(nodes: DataFrame) -> trees.Measured:
    """A tree of ``as_nodes`` for the operators on trees."""
    return trees.Measured(nodes.select(*hierarchy.KEY, "parent_id"), nodes.select(*hierarchy.KEY, "parent_id", "length"))
