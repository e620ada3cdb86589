"""Lengths, weights, midpoints, text and comparison of trees held as node tables.

Nodes that reach no root take no part. Paths come from the hierarchy operator;
everything else is joins and sums that combine map-side, so a tree that holds a
third of the rows is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.functions import vectors as V
from cladeflow.operators import hierarchy, pairing, representations
from cladeflow.session import Scratch

KEY = hierarchy.KEY


def node_sums(rows: DataFrame) -> DataFrame:
    """(tree, node_id, total): the latest finite ``root_to_node_sum`` of each node that has any; the greatest breaks ties."""
    s = F.col("root_to_node_sum")
    return (
        rows.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")))
        .groupBy(*KEY)
        .agg(F.max_by(s, F.struct("written_at", s)).alias("total"))
    )


def edge_lengths(rows: DataFrame) -> DataFrame:
    """(tree, node_id, parent_id, length): the edge above each node, at least 0.

    ``length`` is null where the sum of either end is missing, 0 above a root.
    """
    sums = node_sums(rows)
    above = sums.select("tree", F.col("node_id").alias("parent_id"), F.col("total").alias("upper"))
    both = hierarchy.distinct_nodes(rows).join(sums, KEY, "left").join(above, ["tree", "parent_id"], "left")
    length = F.when(F.col("parent_id").isNull(), 0.0).when(F.col("total").isNotNull() & F.col("upper").isNotNull(), F.greatest(F.lit(0.0), F.col("total") - F.col("upper")))
    return both.select(*KEY, "parent_id", length.alias("length"))


class Measured:
    """A node table with its edges, distances and, where asked for, paths, each written once."""

    def __init__(self, rows: DataFrame, edges: DataFrame | None = None):
        self.rows, self.scratch = rows, Scratch(rows.sparkSession, "trees")
        self.edges = self.scratch.keep(edge_lengths(rows) if edges is None else edges)
        self.parts: dict[str, DataFrame] = {}

    @property
    def paths(self) -> DataFrame:
        """(tree, node_id, root_id, depth, path)."""
        if "paths" not in self.parts:
            self.parts["paths"] = self.scratch.keep(hierarchy.hierarchy_paths(self.rows))
        return self.parts["paths"]

    @property
    def nodes(self) -> DataFrame:
        """(tree, node_id, root_id, depth, distance, n_unknown): sums of known lengths and number of unknown ones from the root."""
        if "nodes" not in self.parts:
            known = self.edges.select(*KEY, F.coalesce("length", F.lit(0.0)).alias("sum_length"), F.col("length").isNull().cast("bigint").alias("sum_unknown"))
            sums = hierarchy.hierarchy_sums(self.rows, known)
            self.parts["nodes"] = self.scratch.keep(sums.withColumnsRenamed({"sum_length": "distance", "sum_unknown": "n_unknown"}))
        return self.parts["nodes"]

    def leaves(self) -> DataFrame:
        """``nodes`` without children."""
        parents = self.edges.where("parent_id IS NOT NULL").select("tree", F.col("parent_id").alias("node_id")).distinct()
        return self.nodes.join(parents, KEY, "left_anti")

    def tips(self) -> DataFrame:
        """(tree, node_id, root_id, depth, path, distance, n_unknown) of rooted nodes without children."""
        return self.paths.join(self.leaves().select(*KEY, "distance", "n_unknown"), KEY)


def shared_steps(a: Column, b: Column) -> Column:
    """Number of leading ids that two paths have in common; ids differ from where the ways part."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda same: same))


def patristic(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(…, lca_id, steps, distance) of (tree, a, b, path_a, path_b) rows of one root.

    ``distance`` is null if an edge on the way between the two has no known
    length; unknown edges above their common ancestor don't matter.
    """
    shared = shared_steps(F.col("path_a"), F.col("path_b"))
    both = pairs.withColumn("shared", shared).where("shared > 0").withColumns(
        {"lca_id": F.get("path_a", F.col("shared") - 1), "steps": F.size("path_a") + F.size("path_b") - 2 * F.col("shared")}
    )
    for side, name in (("a", "a"), ("b", "b"), ("l", "lca_id")):
        both = both.join(nodes.select("tree", F.col("node_id").alias(name), F.col("distance").alias(f"d_{side}"), F.col("n_unknown").alias(f"u_{side}")), ["tree", name])
    known = F.col("u_a") + F.col("u_b") == 2 * F.col("u_l")
    return both.select("tree", "a", "b", "lca_id", "steps", F.when(known, F.col("d_a") + F.col("d_b") - 2 * F.col("d_l")).alias("distance"))


def leaf_weights(m: Measured) -> DataFrame:
    """(tree, root_id, node_id, weight): each edge's length is shared evenly among the tips below it; weights sum to 1 per root.

    Unknown lengths count as 0; without any length all tips weigh the same.
    """
    above = m.tips().select(*KEY, "root_id", F.explode("path").alias("anc"))
    below = above.groupBy("tree", "anc").agg(F.count(F.lit(1)).alias("n_below"))
    share = m.edges.select("tree", F.col("node_id").alias("anc"), "length").join(below, ["tree", "anc"])
    share = share.select("tree", "anc", (F.coalesce("length", F.lit(0.0)) / F.col("n_below")).alias("part"))
    raw = above.join(share, ["tree", "anc"]).groupBy("tree", "root_id", "node_id").agg(F.sum("part").alias("raw"))
    total = raw.groupBy("tree", "root_id").agg(F.sum("raw").alias("total"), F.count(F.lit(1)).alias("n"))
    weight = F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(1 / F.col("n"))
    return raw.join(total, ["tree", "root_id"]).select("tree", "root_id", "node_id", weight.alias("weight"))


def midpoints(m: Measured) -> DataFrame:
    """(tree, root_id, span, below_id, offset): where the longest way between two tips has its middle.

    The tip farthest from the root ends such a way, the tip farthest from it is
    the other end (lengths are never negative). The middle lies on the edge above
    ``below_id``, ``offset`` away from it. Ties go to the least id; unknown
    lengths count as 0; trees without any length have no row.
    """
    tips = m.tips()
    group = ["tree", "root_id"]
    far = tips.groupBy(*group).agg(F.max_by("node_id", F.struct(F.round("distance", 9), -F.col("node_id"))).alias("far_id"))
    way = far.join(m.paths.select("tree", F.col("node_id").alias("far_id"), "path"), ["tree", "far_id"])
    stops = way.select(*group, "far_id", F.posexplode("path").alias("at", "node_id")).join(m.nodes.select(*KEY, "distance"), KEY)
    # One array per root, as long as its farthest tip is deep.
    ruler = stops.groupBy(*group, "far_id").agg(F.array_sort(F.collect_list(F.struct("at", "node_id", "distance"))).alias("stops"))
    there = tips.select(*group, "path", "distance").join(ruler, group)
    shared = shared_steps(F.col("path"), F.transform("stops", lambda s: s["node_id"]))
    ways = there.select(*group, (F.element_at("stops", -1)["distance"] + F.col("distance") - 2 * F.element_at("stops", shared)["distance"]).alias("span"))
    spans = ways.groupBy(*group).agg(F.max("span").alias("span")).where("span > 1e-9")
    middle = spans.join(ruler, group).withColumn("level", F.element_at("stops", -1)["distance"] - F.col("span") / 2)
    first = F.filter("stops", lambda s: F.round(s["distance"], 9) >= F.round(F.col("level"), 9))[0]
    return middle.withColumn("stop", first).select(
        *group, "span", F.col("stop.node_id").alias("below_id"), F.greatest(F.lit(0.0), F.col("stop.distance") - F.col("level")).alias("offset")
    )


def midpoint_rooted(m: Measured) -> DataFrame:
    """(tree, root_id, node_id, parent_id, length): each tree with a new root in the middle of its longest way.

    The new root's id is ``-1 - root_id``. Edges between it and the old root turn
    round; trees without any length stay as they are.
    """
    return rerooted(m, midpoints(m))


def outgroup_rooted(m: Measured, outgroup: DataFrame) -> DataFrame:
    """``rerooted`` in the middle of the edges above the (tree, node_id) tips of ``outgroup``, one per root; roots themselves can't be outgroups."""
    chosen = outgroup.select(*KEY).distinct().join(m.paths.where("depth > 0").select(*KEY, "root_id"), KEY)
    half = chosen.join(m.edges, KEY).select("tree", "root_id", F.col("node_id").alias("below_id"), (F.coalesce("length", F.lit(0.0)) / 2).alias("offset"))
    return rerooted(m, half)


def rerooted(m: Measured, mid: DataFrame) -> DataFrame:
    """(tree, root_id, node_id, parent_id, length): a new root on the edge above ``below_id``, ``offset`` away from it, per (tree, root_id)."""
    nodes = m.paths.select(*KEY, "root_id").join(m.edges.withColumn("length", F.coalesce("length", F.lit(0.0))), KEY)
    way = mid.join(m.paths.select("tree", F.col("node_id").alias("below_id"), "path"), ["tree", "below_id"])
    top = F.size("path") - 1  # position of below_id
    new_root = -1 - F.col("root_id")
    # Node at position i takes the node at i + 1 for its parent, and that node's old edge.
    turned = way.select("tree", "root_id", "offset", top.alias("top"), "path", F.posexplode("path").alias("at", "node_id")).where("top > 0")
    turned = turned.select(
        "tree", "node_id", "offset",
        F.when(F.col("at") >= F.col("top") - 1, new_root).otherwise(F.try_element_at("path", F.col("at") + 2)).alias("new_parent"),
        F.when(F.col("at") == F.col("top"), F.col("node_id")).otherwise(F.try_element_at("path", F.col("at") + 2)).alias("edge_of"),
        (F.col("at") == F.col("top")).alias("is_below"), (F.col("at") == F.col("top") - 1).alias("is_above"),
    )
    old = m.edges.select("tree", F.col("node_id").alias("edge_of"), F.coalesce("length", F.lit(0.0)).alias("old"))
    turned = turned.join(old, ["tree", "edge_of"]).select(
        "tree", "node_id", "new_parent",
        F.when(F.col("is_below"), F.col("offset")).when(F.col("is_above"), F.col("old") - F.col("offset")).otherwise(F.col("old")).alias("new_length"),
    )
    kept = nodes.join(turned, KEY, "left").select(
        "tree", "root_id", "node_id",
        F.coalesce("new_parent", "parent_id").alias("parent_id"), F.coalesce("new_length", "length").alias("length"),
    )
    roots = way.where(F.size("path") > 1).select(
        "tree", "root_id", new_root.alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit(0.0).alias("length")
    )
    return kept.unionByName(roots)


def quoted_label(label: Column) -> Column:
    """A tree label as text: quoted if it holds anything but letters, digits, ``.``, ``-`` and ``_``; empty for null."""
    plain = label.rlike(r"^[A-Za-z0-9._\-]*$")
    return F.when(label.isNull(), "").when(plain, label).otherwise(F.concat(F.lit("'"), F.replace(label, F.lit("'"), F.lit("''")), F.lit("'")))


def length_text(length: Column) -> Column:
    """A length with 12 significant digits, without zeros at its end."""
    text = F.format_string("%.12g", length)
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")


def newick_tokens(paths: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(tree, root_id, key, token): pieces of Newick text; in order of tree, root and ``key`` they make up the file.

    ``key`` is the path of the node, with a closing entry after all below it, so
    the order comes from one range-partitioned sort and no tree is put together
    in a task. Children stand in order of their ids. Null lengths are left out.
    """
    kids = edges.where("parent_id IS NOT NULL").groupBy("tree", "parent_id").agg(F.min("node_id").alias("first_id"))
    inner = kids.select("tree", F.col("parent_id").alias("node_id"), F.lit(True).alias("inner"))
    rows = (
        paths.join(edges.select(*KEY, "parent_id", "length"), KEY)
        .join(kids, ["tree", "parent_id"], "left")
        .join(inner, KEY, "left")
        .join(labels.select(*KEY, "label"), KEY, "left")
    )
    comma = F.when(F.col("node_id") > F.col("first_id"), ",").otherwise("")
    isroot = F.col("parent_id").isNull()
    ending = F.concat(
        quoted_label(F.col("label")),
        F.when(~isroot & F.col("length").isNotNull(), F.concat(F.lit(":"), length_text(F.col("length")))).otherwise(""),
        F.when(isroot, ";").otherwise(""),
    )
    last = F.lit((1 << 63) - 1)
    pieces = F.when(
        F.col("inner"),
        F.array(
            F.struct(F.col("path").alias("key"), F.concat(comma, F.lit("(")).alias("token")),
            F.struct(F.concat("path", F.array(last)).alias("key"), F.concat(F.lit(")"), ending).alias("token")),
        ),
    ).otherwise(F.array(F.struct(F.col("path").alias("key"), F.concat(comma, ending).alias("token"))))
    return rows.select("tree", "root_id", F.inline(pieces))


def fork_pairs(tips: DataFrame, seed: str = "forks-1") -> DataFrame:
    """(tree, level, lca_id, a, b): for each node with tips below two children a pair of tips across two of them, all drawn by hashes.

    ``level`` is the number of edges from the root to the node.
    """
    drawn = F.md5(F.concat_ws(":", F.lit(seed), "tree", F.col("lca_id").cast("string"), F.col("node_id").cast("string")))
    above = tips.select("tree", "node_id", "path", F.posexplode("path").alias("level", "lca_id")).withColumn("child", F.try_element_at("path", F.col("level") + 2))
    best = above.where("child IS NOT NULL").groupBy("tree", "level", "lca_id", "child").agg(F.min(F.struct(drawn.alias("h"), "node_id")).alias("t"))
    # The two least draws of a node: the least, then the least of the other children.
    first = best.groupBy("tree", "level", "lca_id").agg(F.min("t").alias("one"))
    second = best.join(first, ["tree", "level", "lca_id"]).where("t != one").groupBy("tree", "level", "lca_id", "one").agg(F.min("t").alias("two"))
    return second.select("tree", "level", "lca_id", F.least("one.node_id", "two.node_id").alias("a"), F.greatest("one.node_id", "two.node_id").alias("b"))


def preorder(m: Measured) -> DataFrame:
    """(tree, node_id, preorder, first_tip, last_tip): places in preorder per tree (children by id) and the range of tips below each node.

    One range-partitioned sort by path gives the order; ranges are sums that
    combine map-side. Numbers begin at 0 in each tree.
    """
    placed, _ = pairing.ordinals(m.paths.select(*KEY, "path").withColumn("_k", F.struct("tree", "path")), "_k", m.scratch, "_o")
    start = placed.groupBy("tree").agg(F.min("_o").alias("_first"))
    numbered = m.scratch.keep(placed.join(start, "tree").select(*KEY, "path", (F.col("_o") - F.col("_first")).alias("preorder")))
    tips = numbered.join(m.leaves().select(*KEY), KEY)
    order, _ = pairing.ordinals(tips.withColumn("_k", F.struct("tree", "preorder")), "_k", m.scratch, "_o")
    begin = order.groupBy("tree").agg(F.min("_o").alias("_first"))
    ranged = (
        order.join(begin, "tree")
        .select("tree", F.explode("path").alias("node_id"), (F.col("_o") - F.col("_first")).alias("t"))
        .groupBy(*KEY)
        .agg(F.min("t").alias("first_tip"), F.max("t").alias("last_tip"))
    )
    return numbered.select(*KEY, "preorder").join(ranged, KEY)


def pruned(tips: DataFrame, nodes: DataFrame, group: list[str]) -> DataFrame:
    """(group, node_id, parent_id, span, length): each group's tips with the nodes that stay when single-child nodes are suppressed.

    ``tips`` has the group's columns, node_id and path; a group is a tree or a
    tree with a taxon. A node stays if it is such a tip or if tips lie below two
    of its children; the others' lengths are added to what hangs below them.
    ``parent_id`` is the next kept ancestor, ``span`` the edges between, and
    ``length`` theirs, null where one of them is unknown.
    """
    above = tips.select(*group, "node_id", "path", F.posexplode("path").alias("at", "anc"))
    child = F.try_element_at("path", F.col("at") + 2)
    forks = above.where(child.isNotNull()).groupBy(*group, "anc").agg(F.count_distinct(child).alias("n")).where("n >= 2").select(*group, "anc")
    kept = above.join(forks.withColumn("fork", F.lit(True)), [*group, "anc"], "left").where("fork OR anc = node_id")
    w = Window.partitionBy(*group, "node_id").orderBy("at")
    linked = kept.select(*group, F.col("anc").alias("kept_id"), F.lag("anc").over(w).alias("parent_id"), (F.col("at") - F.lag("at").over(w)).alias("span")).distinct()
    low = nodes.select("tree", F.col("node_id").alias("kept_id"), F.col("distance").alias("d1"), F.col("n_unknown").alias("u1"))
    up = nodes.select("tree", F.col("node_id").alias("parent_id"), F.col("distance").alias("d2"), F.col("n_unknown").alias("u2"))
    length = F.when(F.col("u1") == F.col("u2"), F.greatest(F.lit(0.0), F.col("d1") - F.col("d2")))
    measured = linked.join(low, ["tree", "kept_id"]).join(up, ["tree", "parent_id"], "left")
    return measured.select(*group, F.col("kept_id").alias("node_id"), "parent_id", "span", F.when(F.col("parent_id").isNotNull(), length).alias("length"))


def clade_nodes(m: Measured, tops: DataFrame) -> DataFrame:
    """(tree, top_id, node_id, parent_id, length): the nodes of the clades below the (tree, node_id) of ``tops``; a clade's top has no parent and length 0."""
    wanted = tops.select("tree", F.col("node_id").alias("top_id")).distinct()
    below = m.paths.select(*KEY, F.explode("path").alias("top_id")).join(wanted, ["tree", "top_id"])
    istop = F.col("node_id") == F.col("top_id")
    return below.join(m.edges, KEY).select("tree", "top_id", "node_id", F.when(~istop, F.col("parent_id")).alias("parent_id"), F.when(istop, 0.0).otherwise(F.col("length")).alias("length"))


def nearest_marked(paths: DataFrame, marked: DataFrame) -> DataFrame:
    """(tree, node_id, label): of each node the label of its nearest proper ancestor in ``marked`` (tree, node_id, label)."""
    above = paths.select(*KEY, "depth", F.posexplode("path").alias("at", "anc")).where("at < depth")
    named = above.join(marked.select("tree", F.col("node_id").alias("anc"), "label"), ["tree", "anc"])
    return named.groupBy(*KEY).agg(F.max_by("label", "at").alias("label"))


def clade_splits(tips: DataFrame, group: list[str], rooted: bool = True) -> DataFrame:
    """(group, fp1, fp2, n): the informative splits of each group's tips, one row each, from (group, label, path) rows.

    A split is a fingerprint: two 64-bit hashes of its labels combined by
    exclusive or. Rooted ones are clades of more than one and not all tips;
    of unrooted ones both sides have more than one, and the side counts whose
    fingerprint is less, so that the rooting doesn't matter.
    """
    hashes = [F.bit_xor(F.xxhash64("label", F.lit(k))).alias(f"fp{k}") for k in (1, 2)]
    above = tips.select(*group, "label", F.explode("path").alias("node"))
    sides = above.groupBy(*group, "node").agg(*hashes, F.count(F.lit(1)).alias("n"))
    total = tips.groupBy(*group).agg(*[h.alias(f"t{k}") for k, h in zip((1, 2), hashes)], F.count(F.lit(1)).alias("total"))
    both = sides.join(total, group)
    if rooted:
        return both.where("n > 1 AND n < total").select(*group, "fp1", "fp2", "n").distinct()
    own = F.struct("fp1", "fp2", "n")
    other = F.struct(F.col("t1").bitwiseXOR(F.col("fp1")).alias("fp1"), F.col("t2").bitwiseXOR(F.col("fp2")).alias("fp2"), (F.col("total") - F.col("n")).alias("n"))
    return both.where("n > 1 AND total - n > 1").select(*group, F.least(own, other).alias("_s")).select(*group, "_s.*").distinct()


def split_distance(splits: DataFrame, run: str, side: str, first: str, second: str) -> DataFrame:
    """(run, rf, n_first, n_second, normalised): splits that only one side has."""
    both = splits.groupBy(run, "fp1", "fp2", "n").agg(F.count_if(F.col(side) == first).alias("a"), F.count_if(F.col(side) == second).alias("b"))
    counted = both.groupBy(run).agg(F.count_if(F.col("a") != F.col("b")).alias("rf"), F.sum("a").alias("n_first"), F.sum("b").alias("n_second"))
    return counted.withColumn("normalised", F.round(F.try_divide("rf", F.col("n_first") + F.col("n_second")), 6))


def split_ids(tips: DataFrame, group: list[str], smaller_side: bool = False) -> DataFrame:
    """(group, split_id, n): informative clades named by the first 20 hex digits of sha256 over the JSON list of their sorted labels.

    With ``smaller_side`` the list is the lesser of both sides' lists. Each clade's
    labels are listed once, so a row is as long as its tree has tips.
    """
    above = tips.select(*group, "label", F.explode("path").alias("node"))
    lists = above.groupBy(*group, "node").agg(F.array_sort(F.collect_list("label")).alias("own"))
    every = tips.groupBy(*group).agg(F.array_sort(F.collect_list("label")).alias("every"))
    both = lists.join(every, group).where((F.size("own") > 1) & (F.size("own") < F.size("every")))
    side = F.least(F.col("own"), F.array_except("every", "own")) if smaller_side else F.col("own")
    named = both.select(*group, side.alias("side"))
    return named.select(*group, F.substring(F.sha2(F.to_json("side"), 256), 1, 20).alias("split_id"), F.size("side").alias("n")).distinct()


def depth_correlation(tips: DataFrame, run: str, side: str, first: str, second: str) -> DataFrame:
    """(run, n_shared, rho, status): Spearman's rho of (run, side, label, distance) over the labels both sides have.

    Average ranks from the greatest distance down; undefined where a side is
    constant, and with less than three tips.
    """
    wide = tips.groupBy(run, "label").pivot(side, [first, second]).agg(F.max(F.round("distance", 9))).where(F.col(first).isNotNull() & F.col(second).isNotNull())
    ranked = wide.withColumn("a", representations.average_rank(-F.col(first), run)).withColumn("b", representations.average_rank(-F.col(second), run))
    constant = (F.min("a") == F.max("a")) | (F.min("b") == F.max("b"))
    status = F.when(F.count(F.lit(1)) < 3, "too_few").when(constant, "undefined").otherwise("ok")
    counted = ranked.groupBy(run).agg(F.count(F.lit(1)).alias("n_shared"), representations.pearson(F.col("a"), F.col("b")).alias("rho"), status.alias("status"))
    return counted.select(run, "n_shared", F.when(F.col("status") == "ok", F.round("rho", 6)).alias("rho"), "status")


def neighbour_preservation(m: Measured, tips: DataFrame, k: int, anchors: int, dimensions: int, seed: str = "anchors-1") -> DataFrame:
    """(tree, node_id, n_candidates, overlap): how many of the ``k`` tips nearest by vector are among the ``k`` nearest in the tree, over ``k``.

    ``tips`` has (tree, node_id, label, vector). Up to ``anchors`` tips of each
    tree are drawn by a hash; each looks at all tips of its tree. Trees with at
    most ``k`` tips have no row. Ties go to the lesser label.
    """
    unit = tips.select(*KEY, "label", V.unit(F.col("vector")).alias("u")).join(m.paths.select(*KEY, "path"), KEY)
    w = Window.partitionBy("tree").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("label"))), "label")
    sizes = unit.groupBy("tree").agg(F.count(F.lit(1)).alias("n_candidates")).where(F.col("n_candidates") > k)
    asked = unit.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= anchors).join(sizes, "tree").drop("_r")
    other = unit.select("tree", F.col("node_id").alias("b"), F.col("label").alias("label_b"), F.col("u").alias("ub"), F.col("path").alias("path_b"))
    pairs = asked.withColumnsRenamed({"node_id": "a", "path": "path_a"}).join(other, "tree").where("a != b")
    near = pairs.select("tree", "a", "b", "label_b", "n_candidates", "path_a", "path_b", F.round(1 - V.dot(F.col("u"), F.col("ub")), 9).alias("cosine"))
    ways = patristic(near.select("tree", "a", "b", "path_a", "path_b"), m.nodes).select("tree", "a", "b", F.round("distance", 9).alias("way"))
    both = near.drop("path_a", "path_b").join(ways, ["tree", "a", "b"], "left")
    rank = lambda by: F.row_number().over(Window.partitionBy("tree", "a").orderBy(F.col(by).asc_nulls_last(), "label_b"))
    ranked = both.withColumn("r1", rank("cosine")).withColumn("r2", rank("way"))
    hit = F.count_if((F.col("r1") <= k) & (F.col("r2") <= k))
    return ranked.groupBy("tree", F.col("a").alias("node_id"), "n_candidates").agg(F.round(hit / k, 6).alias("overlap"))


def clade_lists(tips: DataFrame) -> DataFrame:
    """(run, side, label, clades): the clades each shared tip is in, widest first, over the tips that both sides of a run have.

    Takes (run, side, label, path) with one row per label and side. A clade is a
    fingerprint (two 64-bit hashes, combined by exclusive or) of its tips and their number; clades
    of one tip or all tips don't count, nodes with the same tips fall together.
    """
    shared = tips.groupBy("run", "label").agg(F.count_distinct("side").alias("n")).where("n = 2").select("run", "label")
    kept = tips.join(shared, ["run", "label"])
    total = kept.groupBy("run", "side").agg(F.count(F.lit(1)).alias("total"))
    above = kept.select("run", "side", "label", F.explode("path").alias("node"))
    clades = (
        above.groupBy("run", "side", "node")
        .agg(F.bit_xor(F.xxhash64("label", F.lit(1))).alias("fp1"), F.bit_xor(F.xxhash64("label", F.lit(2))).alias("fp2"), F.count(F.lit(1)).alias("n"))
        .join(total, ["run", "side"])
    )
    clade = F.when((F.col("n") > 1) & (F.col("n") < F.col("total")), F.struct("n", "fp1", "fp2"))
    lists = above.join(clades.withColumn("clade", clade), ["run", "side", "node"]).groupBy("run", "side", "label")
    return lists.agg(F.sort_array(F.collect_set("clade"), asc=False).alias("clades"))


def compare_sides(lists: DataFrame, first: str, second: str) -> DataFrame:
    """(run, n_shared, rf, n_first, n_second, rf_normalised, kc, kc_normalised) of runs with at least two shared tips.

    Robinson-Foulds counts clades of one side only. Kendall-Colijn (lambda 0) is
    the distance of the vectors of root-to-ancestor edges over all pairs of tips,
    exact though no pair is formed: pairs are counted per clade and per
    intersection of a clade of either side.
    """
    by_clade = lists.select("run", "side", F.posexplode("clades").alias("at", "clade")).groupBy("run", "side", "clade").agg(F.max("at").alias("at"))
    pairs = lambda n: n * (n - 1) / 2
    own = pairs(F.col("clade.n")) * (2 * F.col("at") + 1)
    sides = by_clade.groupBy("run", "clade").agg(
        F.count_if(F.col("side") == first).alias("a"), F.count_if(F.col("side") == second).alias("b"),
        F.sum(F.when(F.col("side") == first, own)).alias("aa"), F.sum(F.when(F.col("side") == second, own)).alias("bb"),
    )
    per_run = sides.groupBy("run").agg(
        F.count_if(F.col("a") != F.col("b")).alias("rf"), F.sum("a").alias("n_first"), F.sum("b").alias("n_second"),
        F.sum("aa").alias("aa"), F.sum("bb").alias("bb"),
    )
    wide = lists.groupBy("run", "label").agg(
        F.max(F.when(F.col("side") == first, F.col("clades"))).alias("ca"), F.max(F.when(F.col("side") == second, F.col("clades"))).alias("cb")
    )
    meets = wide.select("run", F.explode("ca").alias("x"), "cb").select("run", "x", F.explode("cb").alias("y")).groupBy("run", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    cross = meets.groupBy("run").agg(F.sum(pairs(F.col("n"))).alias("ab"))
    counted = wide.groupBy("run").agg(F.count(F.lit(1)).alias("n_shared")).where("n_shared > 1")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    kc = F.sqrt(F.greatest(F.lit(0.0), zero("aa") + zero("bb") - 2 * zero("ab")))
    norms = F.sqrt(zero("aa") + F.col("n_shared")) + F.sqrt(zero("bb") + F.col("n_shared"))
    full = counted.join(per_run, "run", "left").join(cross, "run", "left")
    none = F.lit(0).cast("bigint")
    return full.select(
        "run", "n_shared", F.coalesce("rf", none).alias("rf"), F.coalesce("n_first", none).alias("n_first"), F.coalesce("n_second", none).alias("n_second"),
        F.round(F.try_divide("rf", F.col("n_first") + F.col("n_second")), 6).alias("rf_normalised"),
        F.round(kc, 6).alias("kc"), F.round(kc / norms, 6).alias("kc_normalised"),
    )
