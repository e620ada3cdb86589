"""Queries on tree lengths, comparisons, text and shapes of vector groups, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.functions.text import blank_clean, taxon_name
from cladeflow.operators import nj, pairing, shapes, taxonomy, trees
from cladeflow.operators import representations as R
from cladeflow.plans import vectors
from cladeflow.plans.problems import sql_clean, sql_taxon
from cladeflow.session import Scratch, stored, table

LAST = 2**63 - 1


_measured = vectors._measured


def patristic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Way between each tip and another one drawn from its tree; no distance where a length on the way is unknown."""
    m = _measured(spark, sf_dir)
    both = pairing.partners(m.tips().select("tree", "node_id", "path"), "tree", "node_id")
    pairs = both.withColumnsRenamed({"node_id": "a", "node_id_2": "b", "path": "path_a", "path_2": "path_b"})
    return trees.patristic(pairs, m.nodes).withColumn("distance", F.round("distance", 6))


def level_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tips spread evenly over the levels of their common ancestors: per fork one pair across two of its children, then 500 in all."""
    m = _measured(spark, sf_dir)
    pairs = trees.fork_pairs(m.tips().select("tree", "node_id", "path"))
    order = F.md5(F.concat_ws(":", F.lit("levels-1"), "tree", F.col("a").cast("string"), F.col("b").cast("string")))
    return pairing.by_level(pairs, "level", 500, order).select("tree", "level", "a", "b")


def root_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir)
    return m.nodes.select("tree", "node_id", "root_id", "depth", F.round("distance", 6).alias("distance"), "n_unknown")


def preorder_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.preorder(_measured(spark, sf_dir))


def _labelled(spark, sf_dir, m):
    """(tree, label, node_id, root_id, path, distance): tips whose label is theirs alone in the tree."""
    labels = table(spark, sf_dir, "node_lengths").where("node_kind = 'tip' AND original_label IS NOT NULL").groupBy("tree", "node_id").agg(F.max("original_label").alias("label"))
    own = labels.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("n"), F.max("node_id").alias("node_id")).where("n = 1").drop("n")
    return own.join(m.paths.select("tree", "node_id", "root_id", "path"), ["tree", "node_id"]).join(m.nodes.select("tree", "node_id", "distance", "n_unknown"), ["tree", "node_id"])


def pruned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tree cut down to its labelled tips."""
    m = _measured(spark, sf_dir)
    return trees.pruned(_labelled(spark, sf_dir, m), m.nodes, ["tree"]).withColumn("length", F.round("length", 6))


def collapsed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tree without its single-child nodes, all tips kept."""
    m = _measured(spark, sf_dir)
    return trees.pruned(m.tips(), m.nodes, ["tree"]).withColumn("length", F.round("length", 6))


def genus_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tree cut down to the tips of each genus that its records name."""
    m = _measured(spark, sf_dir)
    genus = (
        table(spark, sf_dir, "bcdm_records")
        .select(F.upper(blank_clean(F.col("processid"))).alias("label"), taxon_name(F.col("genus")).alias("genus"), "record_no")
        .where("label IS NOT NULL AND genus IS NOT NULL")
        .groupBy("label")
        .agg(F.min_by("genus", "record_no").alias("genus"))
    )
    return trees.pruned(_labelled(spark, sf_dir, m).join(genus, "label"), m.nodes, ["tree", "genus"]).withColumn("length", F.round("length", 6))


def _marked(spark, sf_dir):
    """(tree, node_id, label): inner nodes with a name."""
    rows = table(spark, sf_dir, "node_lengths").where("node_kind <> 'tip'").select("tree", "node_id", blank_clean(F.col("original_label")).alias("label"))
    return rows.where("label IS NOT NULL").groupBy("tree", "node_id").agg(F.max("label").alias("label"))


def named_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled tip with the name of its nearest named ancestor."""
    m = _measured(spark, sf_dir)
    tips = _labelled(spark, sf_dir, m).select("tree", "node_id", F.col("label").alias("tip"))
    return trees.nearest_marked(m.paths, _marked(spark, sf_dir)).join(tips, ["tree", "node_id"]).select("tree", "tip", "label")


def named_clades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all clades whose top has a name that no other node of the tree has."""
    m = _measured(spark, sf_dir)
    once = _marked(spark, sf_dir).groupBy("tree", "label").agg(F.count(F.lit(1)).alias("n"), F.max("node_id").alias("node_id")).where("n = 1")
    return trees.clade_nodes(m, once).withColumn("length", F.round("length", 6))


def split_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.split_ids(_labelled(spark, sf_dir, _measured(spark, sf_dir)), ["tree"])


def split_ids_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.split_ids(_labelled(spark, sf_dir, _measured(spark, sf_dir)), ["tree"], smaller_side=True)


class _Rerooted:
    """Each tree as it is (side ``own``) and rooted on the edge of its least labelled tip (side ``outgroup``), over its labelled tips."""

    def __init__(self, spark, sf_dir):
        m = _measured(spark, sf_dir)
        tips = _labelled(spark, sf_dir, m)
        first = tips.groupBy("tree", "root_id").agg(F.min_by("node_id", "label").alias("node_id"))
        turned = trees.outgroup_rooted(m, first)
        scratch = Scratch(spark, "rerooted")
        turned = scratch.keep(turned)
        again = trees.Measured(turned.select("tree", "node_id", "parent_id"), turned.select("tree", "node_id", "parent_id", "length"))
        moved = tips.select("tree", "label", "node_id").join(again.paths, ["tree", "node_id"]).join(again.nodes.select("tree", "node_id", "distance"), ["tree", "node_id"])
        run = F.concat_ws("#", "tree", F.col("root_id").cast("string")).alias("run")
        old = tips.select("tree", "label", run)
        columns = ["run", "side", "label", "path", "distance"]
        self.tips = scratch.keep(
            tips.select(run, F.lit("own").alias("side"), "label", "path", "distance")
            .select(*columns)
            .unionByName(moved.join(old, ["tree", "label"]).select("run", F.lit("outgroup").alias("side"), "label", "path", "distance").select(*columns))
        )


def _rerooted(spark, sf_dir):
    return stored("rerooted", table(spark, sf_dir, "node_lengths"), lambda: _Rerooted(spark, sf_dir))


def rerooted_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robinson-Foulds of each tree and its rerooted form: rooted clades may differ, unrooted splits can't."""
    tips = _rerooted(spark, sf_dir).tips
    parts = [
        trees.split_distance(trees.clade_splits(tips, ["run", "side"], rooted), "run", "side", "own", "outgroup").select(F.lit(kind).alias("kind"), "*")
        for kind, rooted in (("rooted", True), ("unrooted", False))
    ]
    return parts[0].unionByName(parts[1])


def rerooted_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman's rho of the tips' distances from the root before and after rerooting."""
    return trees.depth_correlation(_rerooted(spark, sf_dir).tips, "run", "side", "own", "outgroup")


def neighbour_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of up to 20 tips per tree, how many of the 3 nearest by vector are among the 3 nearest in the tree."""
    m = _measured(spark, sf_dir)
    vectors_ = vectors._bundle(spark, sf_dir).select(F.upper(blank_clean(F.col("ids"))).alias("label"), "faiss_id", "embedding").where("label IS NOT NULL")
    first = vectors_.groupBy("label").agg(F.min_by("embedding", "faiss_id").alias("vector"))
    tips = _labelled(spark, sf_dir, m).select("tree", "node_id", "label").join(first, "label")
    return trees.neighbour_preservation(m, tips, 3, 20, vectors.DIM)


def leaf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.leaf_weights(_measured(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def tree_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = trees.midpoints(_measured(spark, sf_dir))
    return m.select("tree", "root_id", F.round("span", 6).alias("span"), "below_id", F.round("offset", 6).alias("offset"))


def midpoint_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.midpoint_rooted(_measured(spark, sf_dir)).withColumn("length", F.round("length", 6))


def newick_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "node_lengths")
    m = _measured(spark, sf_dir)
    labels = rows.groupBy("tree", "node_id").agg(F.max("original_label").alias("label"))
    tokens = trees.newick_tokens(m.paths, m.edges, labels)
    return tokens.withColumn("key", F.array_join(F.col("key").cast("array<string>"), "/"))


def taxonomy_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tree against the taxonomy of its tips' records: Robinson-Foulds and Kendall-Colijn over the tips that have one."""
    tips = vectors._tips(spark, sf_dir).select(F.col("tree").alias("run"), F.lit("tree").alias("side"), "label", F.col("path").cast("array<string>").alias("path"))
    ranks = F.struct(*[taxon_name(F.col(r)).alias(r) for r in taxonomy.RANKS])
    records = (
        table(spark, sf_dir, "bcdm_records")
        .groupBy(F.upper(blank_clean(F.col("processid"))).alias("label"))
        .agg(F.min_by(ranks, "record_no").alias("taxa"))
        .where("label IS NOT NULL")
    )
    steps = [F.when(F.col(f"taxa.{r}").isNotNull(), F.concat(F.lit(f"{r}:"), F.col(f"taxa.{r}"))) for r in taxonomy.RANKS]
    path = F.array_distinct(F.array(*[F.concat_ws("|", F.lit("root"), *steps[:k]) for k in range(len(steps) + 1)]))
    taxa = tips.select("run", "label").join(records, "label").select("run", F.lit("taxonomy").alias("side"), "label", path.alias("path"))
    return trees.compare_sides(trees.clade_lists(tips.unionByName(taxa)), "tree", "taxonomy").withColumnRenamed("run", "tree")


def covariance_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = shapes.moment_cells(table(spark, sf_dir, "embeddings"), "label", "embedding", vectors.DIM)
    return shapes.covariances(cells).withColumn("cov", F.round("cov", 6) + 0.0)  # no negative zeros


def gaussian_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each genus' Gaussian to that of its family."""
    named = vectors._bundle(spark, sf_dir).select(taxon_name(F.col("family")).alias("family"), taxon_name(F.col("genus")).alias("genus"), "embedding")
    rows = named.where("family IS NOT NULL AND genus IS NOT NULL").withColumn("path", F.concat_ws("|", "family", "genus"))
    cells = shapes.moment_cells(rows, "path", "embedding", vectors.DIM)
    parents = rows.select(F.col("path").alias("grp"), F.col("family").alias("parent")).distinct()
    return shapes.gaussian_distances(cells, parents, vectors.DIM).withColumn("distance", F.round("distance", 5))


def spherical_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean directions of the genera's vectors on the unit sphere."""
    rows = table(spark, sf_dir, "embedding_bundle").select(taxon_name(F.col("genus")).alias("genus"), "embedding")
    means = shapes.spherical_means(rows, "genus", "embedding", vectors.DIM)
    return means.select("genus", "n", F.transform("mean", lambda x: F.round(x, 6)).alias("mean"))


def _specimens(spark, sf_dir):
    """Specimens with a usable vector: once per id, the first to arrive."""
    rows = vectors._bundle(spark, sf_dir).select("faiss_id", *[taxon_name(F.col(r)).alias(r) for r in vectors.TAXA], F.upper(blank_clean(F.col("ids"))).alias("id"), "embedding")
    first = rows.where("id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct("faiss_id", *vectors.TAXA, "embedding"), "faiss_id").alias("r")).select("id", "r.*")
    return stored("specimens", first, lambda: Scratch(spark, "specimens").keep(first))


def _tree_summary(tree, name):
    """Edges, clamped lengths and total length of a tree, by the rank of what its connectors join."""
    return tree.groupBy(F.lit(name).alias("method"), "rank").agg(
        F.count(F.lit(1)).alias("n_edges"), F.sum("clamped").alias("n_clamped"), F.round(F.sum("length"), 4).alias("total"), F.count_if(F.col("child").contains("#")).alias("n_joints")
    )


def grafted_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the tree over orders, families, genera, species and specimens by centroids."""
    tree = nj.taxon_tree(_specimens(spark, sf_dir), "id", list(vectors.TAXA), "embedding", vectors.DIM)
    return tree.withColumn("length", F.round("length", 6))


def family_trees_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three representations on the same specimens: trees of families and their specimens, summed up; Gaussians and spherical means take minutes more."""
    rows = _specimens(spark, sf_dir)
    parts = [_tree_summary(nj.taxon_tree(rows, "id", ["family"], "embedding", vectors.DIM, m), m) for m in ("centroid", "medoid", "weighted")]
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    return everything


def unified_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families, genera, species and specimens by unit means without local rooting, and one root in the middle of the whole."""
    tree = nj.taxon_tree(_specimens(spark, sf_dir), "id", list(vectors.TAXA[1:]), "embedding", vectors.DIM, style="plain")
    m = nj.measured(Scratch(spark, "unified").keep(nj.as_nodes(tree, "unified")))
    return trees.midpoint_rooted(m).withColumn("length", F.round("length", 6))


def unsupervised_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specimens in clusters by k-means instead of taxa."""
    rows = _specimens(spark, sf_dir)
    k = max(1, min(2000, rows.count() // 10))
    tree = nj.unsupervised_tree(rows.select(F.col("faiss_id"), "embedding"), "faiss_id", "embedding", vectors.DIM, k)
    return tree.withColumn("length", F.round("length", 6))


def clade_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of the specimens of the family with most of them, built anew from its genera by medoids."""
    rows = _specimens(spark, sf_dir)
    top = rows.where("family IS NOT NULL").groupBy("family").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "family").limit(1).select("family")
    return nj.taxon_tree(rows.join(top, "family"), "id", ["genus", "species"], "embedding", vectors.DIM, "medoid").withColumn("length", F.round("length", 6))


QUERIES = {
    f.__name__: f
    for f in (
        patristic_pairs, level_pairs, root_sums, preorder_ranges, pruned_nodes, collapsed_nodes, genus_trees, named_ancestors, named_clades,
        split_ids, split_ids_smaller, rerooted_splits, rerooted_depths, neighbour_preservation, leaf_weights, tree_midpoints, midpoint_edges, newick_tokens, taxonomy_topology, covariance_cells,
        gaussian_distance, spherical_mean, grafted_taxa, family_trees_by_method,
        unified_tree, unsupervised_tree, clade_rebuild,
    )
}

_LENGTHS = f"""{vectors._SQL_WALK}, su AS (SELECT tree, node_id, arg_max(root_to_node_sum, row(written_at, root_to_node_sum)) AS total FROM node_lengths
        WHERE isfinite(root_to_node_sum) GROUP BY ALL),
      ed AS (SELECT nodes.tree, nodes.node_id, nodes.parent_id,
               CASE WHEN nodes.parent_id = -1 THEN 0 WHEN a.total IS NOT NULL AND b.total IS NOT NULL THEN greatest(0, a.total - b.total) END AS length
             FROM nodes LEFT JOIN su a ON a.tree = nodes.tree AND a.node_id = nodes.node_id LEFT JOIN su b ON b.tree = nodes.tree AND b.node_id = nodes.parent_id),
      pa AS (SELECT tree, node_id, path[1] AS root_id, path FROM s WHERE fate = 'rooted'),
      up AS (SELECT tree, root_id, node_id, unnest(path) AS anc FROM pa),
      di AS (SELECT up.tree, up.root_id, up.node_id, sum(coalesce(length, 0)) AS distance, count(*) - count(length) AS n_unknown
             FROM up JOIN ed ON ed.tree = up.tree AND ed.node_id = up.anc GROUP BY ALL),
      le AS (SELECT pa.*, distance, n_unknown FROM pa JOIN di ON di.tree = pa.tree AND di.node_id = pa.node_id
             WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.tree = pa.tree AND c.parent_id = pa.node_id))"""
_SHARED = "len(list_filter(range(1, least(len({p}), len({q})) + 1), lambda i: {p}[i] = {q}[i]))"
_TAXA_PATH = ", ".join(
    "concat_ws('|', 'root'" + "".join(f", '{r}:' || {sql_taxon(r)}" for r in taxonomy.RANKS[:k]) + ")" for k in range(len(taxonomy.RANKS) + 1)
)

_OWN = """lb AS (SELECT tree, node_id, max(original_label) AS label FROM node_lengths WHERE node_kind = 'tip' AND original_label IS NOT NULL GROUP BY ALL),
      on1 AS (SELECT tree, label, max(node_id) AS node_id FROM lb GROUP BY ALL HAVING count(*) = 1),
      own AS (SELECT on1.tree, label, pa.node_id, pa.root_id, path FROM on1 JOIN pa ON pa.tree = on1.tree AND pa.node_id = on1.node_id)"""
_MARKED = f"""mk AS (SELECT tree, node_id, concat(max({sql_clean("original_label")}), '') AS label FROM node_lengths WHERE node_kind <> 'tip' AND {sql_clean("original_label")} IS NOT NULL GROUP BY ALL)"""
_CLADES = """cl AS (SELECT c.tree, c.node, own, every FROM (SELECT tree, node, list(label ORDER BY label) AS own FROM (SELECT tree, label, unnest(path) AS node FROM own) GROUP BY ALL) c
        JOIN (SELECT tree, list(label ORDER BY label) AS every FROM own GROUP BY ALL) e ON e.tree = c.tree WHERE len(own) > 1 AND len(own) < len(every))"""
_CLADES_BY_ROOT = """cr AS (SELECT c.tree, c.root_id, c.tree || '#' || c.root_id AS run, c.node, own, every FROM (SELECT tree, root_id, node, list(label ORDER BY label) AS own
          FROM (SELECT tree, root_id, label, unnest(path) AS node FROM own) GROUP BY ALL) c
        JOIN (SELECT tree, root_id, list(label ORDER BY label) AS every FROM own GROUP BY ALL) e ON e.tree = c.tree AND e.root_id = c.root_id)"""


def _sql_pruned(source: str, group: str) -> str:
    equal = " AND ".join(f"fo.{g} = ab.{g}" for g in group.split(", "))
    return f"""ab AS (SELECT {group}, node_id, path[i] AS anc, path[i + 1] AS child, i FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM {source})),
      fo AS (SELECT {group}, anc FROM ab WHERE child IS NOT NULL GROUP BY ALL HAVING count(DISTINCT child) >= 2),
      ke AS (SELECT ab.* FROM ab LEFT JOIN fo ON {equal} AND fo.anc = ab.anc WHERE fo.anc IS NOT NULL OR ab.anc = node_id),
      kl AS (SELECT DISTINCT {group}, anc AS node_id, lag(anc) OVER u AS parent_id, (i - lag(i) OVER u)::INT AS span FROM ke WINDOW u AS (PARTITION BY {group}, node_id ORDER BY i)),
      pn AS (SELECT kl.*, CASE WHEN parent_id IS NOT NULL AND a.n_unknown = b.n_unknown THEN round(greatest(0, a.distance - b.distance), 6) END AS length FROM kl
        JOIN di a ON a.tree = kl.tree AND a.node_id = kl.node_id LEFT JOIN di b ON b.tree = kl.tree AND b.node_id = kl.parent_id)"""


SQL = {
    "patristic_pairs": f"""{_LENGTHS}, {vectors._PARTNERS.format(source="le", extra=", path, distance, n_unknown")},
        b AS (SELECT tree, a, b, path AS p, path_2 AS q, distance AS da, n_unknown AS ua FROM pt), k AS (SELECT *, {_SHARED.format(p="p", q="q")} AS shared FROM b)
        SELECT k.tree, a, b, p[shared] AS lca_id, (len(p) + len(q) - 2 * shared)::INT AS steps,
          CASE WHEN ua + o.n_unknown = 2 * di.n_unknown THEN round(da + o.distance - 2 * di.distance, 6) END AS distance
        FROM k JOIN di ON di.tree = k.tree AND di.node_id = k.p[k.shared] JOIN di o ON o.tree = k.tree AND o.node_id = k.b WHERE shared > 0""",
    "root_sums": f"""{_LENGTHS} SELECT tree, node_id, root_id, (len(path) - 1)::BIGINT AS depth, round(distance, 6) AS distance, n_unknown FROM di JOIN pa USING (tree, node_id, root_id)""",
    "preorder_ranges": f"""{_LENGTHS}, pr AS (SELECT tree, node_id, path, row_number() OVER (PARTITION BY tree ORDER BY path) - 1 AS preorder FROM pa),
        ti AS (SELECT tree, path, row_number() OVER (PARTITION BY tree ORDER BY path) - 1 AS t FROM le),
        rg AS (SELECT tree, node_id, min(t) AS first_tip, max(t) AS last_tip FROM (SELECT tree, t, unnest(path) AS node_id FROM ti) GROUP BY ALL)
        SELECT tree, node_id, preorder, first_tip, last_tip FROM pr JOIN rg USING (tree, node_id)""",
    "pruned_nodes": f"""{_LENGTHS}, {_OWN}, {_sql_pruned("own", "tree")} SELECT tree, node_id, parent_id, span, length FROM pn""",
    "collapsed_nodes": f"""{_LENGTHS}, {_sql_pruned("le", "tree")} SELECT tree, node_id, parent_id, span, length FROM pn""",
    "genus_trees": f"""{_LENGTHS}, {_OWN}, gn AS (SELECT label, arg_min(genus, record_no) AS genus FROM (SELECT upper({sql_clean("processid")}) AS label, {sql_taxon("genus")} AS genus, record_no
          FROM bcdm_records) WHERE label IS NOT NULL AND genus IS NOT NULL GROUP BY label), og AS (SELECT own.*, genus FROM own JOIN gn ON gn.label = own.label),
        {_sql_pruned("og", "tree, genus")} SELECT tree, genus, node_id, parent_id, span, length FROM pn""",
    "named_ancestors": f"""{_LENGTHS}, {_OWN}, {_MARKED}, ab AS (SELECT tree, label AS tip, path[i] AS anc, i FROM (SELECT *, unnest(range(1, len(path))) AS i FROM own))
        SELECT tree, tip, label FROM (SELECT ab.tree, tip, mk.label, row_number() OVER (PARTITION BY ab.tree, tip ORDER BY i DESC) AS r
          FROM ab JOIN mk ON mk.tree = ab.tree AND mk.node_id = ab.anc) WHERE r = 1""",
    "named_clades": f"""{_LENGTHS}, {_MARKED}, tp AS (SELECT tree, max(node_id) AS top_id FROM mk GROUP BY tree, label HAVING count(*) = 1)
        SELECT up.tree, top_id, up.node_id, CASE WHEN up.node_id <> top_id THEN ed.parent_id END AS parent_id, CASE WHEN up.node_id = top_id THEN 0 ELSE round(length, 6) END AS length
        FROM up JOIN tp ON tp.tree = up.tree AND tp.top_id = up.anc JOIN ed ON ed.tree = up.tree AND ed.node_id = up.node_id""",
    "split_ids": f"""{_LENGTHS}, {_OWN}, {_CLADES} SELECT DISTINCT tree, substr(sha256(to_json(own)::VARCHAR), 1, 20) AS split_id, len(own)::INT AS n FROM cl""",
    "split_ids_smaller": f"""{_LENGTHS}, {_OWN}, {_CLADES}, sd AS (SELECT tree, least(own, list_sort(list_filter(every, lambda x: NOT list_contains(own, x)))) AS side FROM cl)
        SELECT DISTINCT tree, substr(sha256(to_json(side)::VARCHAR), 1, 20) AS split_id, len(side)::INT AS n FROM sd""",
    "rerooted_splits": f"""{_LENGTHS}, {_OWN}, {_CLADES_BY_ROOT},
        og AS (SELECT tree, root_id, arg_min(node_id, label) AS tip FROM own GROUP BY ALL), wy AS (SELECT og.tree, og.root_id, unnest(pa.path) AS node FROM og JOIN pa ON pa.tree = og.tree AND pa.node_id = og.tip),
        st AS (SELECT cr.run, 'own' AS side, own FROM cr UNION SELECT cr.run, 'outgroup', CASE WHEN wy.node IS NULL THEN own ELSE list_sort(list_filter(every, lambda x: NOT list_contains(own, x))) END
          FROM cr LEFT JOIN wy ON wy.tree = cr.tree AND wy.root_id = cr.root_id AND wy.node = cr.node),
        sz AS (SELECT DISTINCT run, every FROM cr), rt AS (SELECT DISTINCT st.run, side, own AS s FROM st JOIN sz USING (run) WHERE len(own) > 1 AND len(own) < len(every)),
        un AS (SELECT DISTINCT st.run, side, least(own, list_sort(list_filter(every, lambda x: NOT list_contains(own, x)))) AS s FROM st JOIN sz USING (run) WHERE len(own) > 1 AND len(every) - len(own) > 1),
        ct AS (SELECT kind, run, s, count(*) FILTER (side = 'own') AS a, count(*) FILTER (side = 'outgroup') AS b FROM (SELECT 'rooted' AS kind, * FROM rt UNION ALL SELECT 'unrooted', * FROM un) GROUP BY ALL)
        SELECT kind, run, count(*) FILTER (a <> b) AS rf, sum(a)::BIGINT AS n_first, sum(b)::BIGINT AS n_second, round(count(*) FILTER (a <> b) / (sum(a) + sum(b)), 6) AS normalised FROM ct GROUP BY ALL""",
    "leaf_weights": f"""{_LENGTHS}, ab AS (SELECT tree, root_id, node_id, unnest(path) AS anc FROM le),
        be AS (SELECT tree, anc, count(*) AS n FROM ab GROUP BY ALL),
        ra AS (SELECT ab.tree, root_id, ab.node_id, sum(coalesce(length, 0) / n) AS raw FROM ab JOIN be ON be.tree = ab.tree AND be.anc = ab.anc
          JOIN ed ON ed.tree = ab.tree AND ed.node_id = ab.anc GROUP BY ALL)
        SELECT tree, root_id, node_id, round(CASE WHEN sum(raw) OVER w > 0 THEN raw / sum(raw) OVER w ELSE 1 / count(*) OVER w END, 6) AS weight
        FROM ra WINDOW w AS (PARTITION BY tree, root_id)""",
    "tree_midpoints": f"""{_LENGTHS}, pr AS (SELECT a.tree, a.root_id, a.node_id AS a, a.path AS p, a.distance AS da, b.distance AS db,
          a.path[{_SHARED.format(p="a.path", q="b.path")}] AS lca FROM le a JOIN le b ON a.tree = b.tree AND a.root_id = b.root_id AND a.distance >= b.distance),
        sp AS (SELECT pr.*, da + db - 2 * distance AS span FROM pr JOIN di ON di.tree = pr.tree AND di.node_id = pr.lca),
        be AS (SELECT tree, root_id, arg_max(struct_pack(p := p, da := da, span := span), row(round(span, 9), round(da, 9), -a)) AS w FROM sp GROUP BY ALL),
        wa AS (SELECT tree, root_id, w.span AS span, w.da - w.span / 2 AS level, unnest(w.p) AS node, unnest(range(1, len(w.p) + 1)) AS i FROM be WHERE w.span > 1e-9)
        SELECT wa.tree, wa.root_id, round(any_value(span), 6) AS span, arg_min(wa.node, i) AS below_id,
          round(greatest(0, arg_min(distance, i) - any_value(level)), 6) AS "offset"
        FROM wa JOIN di ON di.tree = wa.tree AND di.node_id = wa.node WHERE round(distance, 9) >= round(level, 9) GROUP BY ALL""",
    "newick_tokens": f"""{_LENGTHS}, la AS (SELECT tree, node_id, max(original_label) AS label FROM node_lengths GROUP BY ALL),
        ki AS (SELECT tree, parent_id, min(node_id) AS first_id FROM nodes GROUP BY ALL),
        r AS (SELECT pa.tree, root_id, array_to_string(path, '/') AS key, k.first_id IS NOT NULL AS inside,
            CASE WHEN ed.parent_id <> -1 AND pa.node_id > f.first_id THEN ',' ELSE '' END AS comma,
            (CASE WHEN label IS NULL THEN '' WHEN regexp_full_match(label, '[A-Za-z0-9._\\-]*') THEN label ELSE '''' || replace(label, '''', '''''') || '''' END)
            || (CASE WHEN ed.parent_id <> -1 AND length IS NOT NULL THEN ':' || printf('%.12g', length) ELSE '' END)
            || (CASE WHEN ed.parent_id = -1 THEN ';' ELSE '' END) AS ending
          FROM pa JOIN ed ON ed.tree = pa.tree AND ed.node_id = pa.node_id LEFT JOIN ki k ON k.tree = pa.tree AND k.parent_id = pa.node_id
          LEFT JOIN ki f ON f.tree = pa.tree AND f.parent_id = ed.parent_id LEFT JOIN la ON la.tree = pa.tree AND la.node_id = pa.node_id)
        SELECT tree, root_id, key, comma || CASE WHEN inside THEN '(' ELSE ending END AS token FROM r
        UNION ALL SELECT tree, root_id, key || '/{LAST}', ')' || ending FROM r WHERE inside""",
    "taxonomy_topology": f"""{vectors._TIPS}, tx AS (SELECT label, arg_min(path, record_no) AS path FROM (SELECT upper({sql_clean("processid")}) AS label,
          list_distinct([{_TAXA_PATH}]) AS path, record_no FROM bcdm_records) WHERE label IS NOT NULL GROUP BY label),
        k AS (SELECT tree, 'a' AS side, tips.label, tips.path::VARCHAR[] AS path FROM tips SEMI JOIN tx ON tx.label = tips.label
              UNION ALL SELECT tree, 'b', tips.label, tx.path FROM tips JOIN tx ON tx.label = tips.label),
        tot AS (SELECT tree, count(*) AS total FROM k WHERE side = 'a' GROUP BY ALL HAVING total > 1),
        ab AS (SELECT tree, side, label, unnest(path) AS node FROM k),
        cl AS (SELECT tree, side, node, string_agg(label, '|' ORDER BY label) AS fp, count(*) AS n FROM ab GROUP BY tree, side, node),
        tc AS (SELECT DISTINCT ab.tree, ab.side, label, fp FROM ab JOIN cl ON cl.tree = ab.tree AND cl.side = ab.side AND cl.node = ab.node
               JOIN tot ON tot.tree = ab.tree WHERE n > 1 AND n < total),
        g AS (SELECT tree, fp, count(DISTINCT side) FILTER (side = 'a') AS a, count(DISTINCT side) FILTER (side = 'b') AS b FROM tc GROUP BY ALL),
        rf AS (SELECT tree, count(*) FILTER (a <> b) AS rf, sum(a)::BIGINT AS n_first, sum(b)::BIGINT AS n_second FROM g GROUP BY ALL),
        pm AS (SELECT x.tree, x.label AS l1, y.label AS l2, count(*) FILTER (x.side = 'a') AS ma, count(*) FILTER (x.side = 'b') AS mb
               FROM tc x JOIN tc y ON x.tree = y.tree AND x.side = y.side AND x.fp = y.fp AND x.label < y.label GROUP BY ALL),
        kc AS (SELECT tree, sum((ma - mb) * (ma - mb)) AS d, sum(ma * ma) AS aa, sum(mb * mb) AS bb FROM pm GROUP BY ALL)
        SELECT tot.tree, total AS n_shared, coalesce(rf, 0) AS rf, coalesce(n_first, 0) AS n_first, coalesce(n_second, 0) AS n_second,
          round(CASE WHEN n_first + n_second > 0 THEN rf / (n_first + n_second) END, 6) AS rf_normalised, round(sqrt(coalesce(d, 0)), 6) AS kc,
          round(sqrt(coalesce(d, 0)) / (sqrt(coalesce(aa, 0) + total) + sqrt(coalesce(bb, 0) + total)), 6) AS kc_normalised
        FROM tot LEFT JOIN rf ON rf.tree = tot.tree LEFT JOIN kc ON kc.tree = tot.tree""",
    "covariance_cells": f"""WITH {vectors._CELLS}, l AS (SELECT vec_id, label, i - 1 AS dim, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings))
        SELECT a.label::VARCHAR AS grp, count(*) AS n, a.dim::INT AS i, b.dim::INT AS j, round(covar_samp(a.x, b.x), 6) + 0.0 AS cov
        FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY a.label, a.dim, b.dim HAVING count(*) > 1""",
}
