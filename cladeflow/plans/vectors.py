"""Queries on vectors and trees, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeflow.functions import vectors as V
from cladeflow.functions.text import blank_clean, taxon_name
from cladeflow.operators import hierarchy, nj, pairing, trees
from cladeflow.operators import representations as R
from cladeflow.plans.problems import _SQL_WALK, sql_clean, sql_taxon
from cladeflow.session import Scratch, stored, table
from cladeflow.sources import contracts

DIM = 64
PAIRS = 20_000
TAXA = ("tax_order", "family", "genus", "species")


def _bundle(spark, sf_dir):
    rows = table(spark, sf_dir, "embedding_bundle")
    return rows.where(V.usable(F.col("embedding"), DIM))


def vector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why vectors are left out, first reason first."""
    e = F.col("embedding")
    reason = (
        F.when(e.isNull(), "missing")
        .when(F.size(e) != DIM, "dimensions")
        .when(~V.usable(e, DIM), "not_usable")
        .when(taxon_name(F.col("species")).isNull(), "no_species")
        .otherwise("kept")
    )
    return table(spark, sf_dir, "embedding_bundle").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def vector_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.centroid_cells(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "dim", "n", F.round(F.col("total") / F.col("n"), 6).alias("mean"))


def centroid_of_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families' unit means of their genera's unit means of their species' unit means."""
    rows = _bundle(spark, sf_dir).select(*[taxon_name(F.col(r)).alias(r) for r in TAXA[1:]], V.unit(F.col("embedding")).alias("u"))
    means = R.nested_centroids(rows, list(TAXA[1:]), "u")
    return means.select("family", F.posexplode("centroid").alias("dim", "x")).select("family", "dim", F.round("x", 6).alias("x"))


def cosine_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cosine_medoids(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


def genus_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bundle(spark, sf_dir).select(taxon_name(F.col("genus")).alias("genus"), "faiss_id", "embedding").where("genus IS NOT NULL")
    return R.cosine_medoids(rows, "genus", "faiss_id", "embedding")


def covariance_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode(V.doubles(F.col("embedding"))).alias("dim", "x"))
    per_dim = cells.groupBy("label", "dim").agg(F.var_samp("x").alias("v"), F.avg("x").alias("m"))
    return per_dim.groupBy("label").agg(F.round(F.sum("v"), 6).alias("trace"), F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("norm"))


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 20, 5, DIM).withColumn("similarity", F.round("similarity", 6))


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's closest label mean."""
    rows = table(spark, sf_dir, "embeddings")
    means = R.centroids(rows, "label", "embedding").select(F.col("label").cast("bigint").alias("label"), F.col("centroid").alias("mean"))
    return R.nearest(rows, "vec_id", "embedding", means, DIM)


def _pairs(spark, sf_dir):
    """A seeded sample of pairs of specimens with both distances, how they are related and the first rank they differ at."""
    rows = _bundle(spark, sf_dir).select("faiss_id", *[taxon_name(F.col(r)).alias(r) for r in TAXA], "embedding")
    pairs = pairing.sampled_pairs(rows, "faiss_id", PAIRS)
    names = {r: (F.col(r), F.col(f"{r}_2")) for r in TAXA}
    return pairs.select(
        "faiss_id", "faiss_id_2",
        V.cosine_distance(F.col("embedding"), F.col("embedding_2")).alias("cosine"),
        V.euclidean(V.unit(F.col("embedding")), V.unit(F.col("embedding_2"))).alias("euclid"),
        R.relation(names).alias("relation"),
        R.first_difference(names, "within_species").alias("first_rank"),
    )


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("cosine", "euclid")})


def distance_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How Euclidean distances of unit vectors meet cosine ones, by the first rank that differs and over all pairs."""
    pairs = Scratch(spark, "fit").keep(_pairs(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("cosine", "euclid")}))
    both = pairs.unionByName(pairs.withColumn("first_rank", F.lit("all")))
    ranked = both.withColumn("rx", R.average_rank(F.col("cosine"), "first_rank")).withColumn("ry", R.average_rank(F.col("euclid"), "first_rank"))
    return ranked.groupBy("first_rank").agg(*R.fit_measures(F.col("cosine"), F.col("euclid")), F.round(R.pearson(F.col("rx"), F.col("ry")), 6).alias("spearman"))


def relation_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of the two distances over all 32 unions of relations."""
    pairs = _pairs(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("cosine", "euclid")})
    return R.scatter_metrics(pairs, "cosine", "euclid", 1 << len(R.RELATIONS))


def genus_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of specimens within each genus that has at most 50 of them, with their mean distance."""
    rows = _bundle(spark, sf_dir).select("faiss_id", taxon_name(F.col("genus")).alias("genus"), "embedding").where("genus IS NOT NULL")
    small = rows.groupBy("genus").agg(F.count(F.lit(1)).alias("n")).where("n <= 50").select("genus")
    pairs = pairing.all_within_groups(rows.join(small, "genus"), "genus", "faiss_id", 100_000_000)
    return pairs.groupBy("genus").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(V.cosine_distance(F.col("embedding"), F.col("embedding_2"))), 6).alias("mean_cosine"))


def record_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of 200 specimens."""
    return pairing.sampled_rows(_bundle(spark, sf_dir), "faiss_id", 200).select("faiss_id", "ids", "bundle_no")


def genus_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per family and genus: specimens with a usable vector, those that the records name, and those in the sample."""
    rows = _bundle(spark, sf_dir).select("faiss_id", F.upper(blank_clean(F.col("ids"))).alias("id"), *[taxon_name(F.col(r)).alias(r) for r in ("family", "genus")])
    known = table(spark, sf_dir, "bcdm_records").select(F.upper(blank_clean(F.col("processid"))).alias("id"), F.lit(True).alias("known")).where("id IS NOT NULL").distinct()
    sample = record_sample(spark, sf_dir).select("faiss_id", F.lit(True).alias("taken"))
    both = rows.where("family IS NOT NULL AND genus IS NOT NULL").join(known, "id", "left").join(sample, "faiss_id", "left")
    return both.groupBy("family", "genus").agg(F.count(F.lit(1)).alias("n_eligible"), F.count("known").alias("n_matched"), F.count("taken").alias("n_analysed"))


def one_label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process ids by the number of species that the bundles name for them."""
    rows = table(spark, sf_dir, "embedding_bundle").select(F.upper(blank_clean(F.col("ids"))).alias("id"), blank_clean(F.col("species")).alias("species"))
    return contracts.one_label(rows.where("id IS NOT NULL"), "id", "species")


def cohort_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genera of specimens by the records and by the bundles: ids of one side only, and other genera."""
    records = table(spark, sf_dir, "bcdm_records").select(F.upper(blank_clean(F.col("processid"))).alias("id"), taxon_name(F.col("genus")).alias("genus"), "record_no")
    bundle = table(spark, sf_dir, "embedding_bundle").select(F.upper(blank_clean(F.col("ids"))).alias("id"), taxon_name(F.col("genus")).alias("genus"), "faiss_id")
    first = lambda rows, order: rows.where("id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct("genus"), order).alias("g")).select("id", "g.genus")
    return contracts.same_cohort(first(records, "record_no"), first(bundle, "faiss_id"), "id", "genus")


def vectors_with_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of two orders' specimens with the length of their record's sequence, if that is 50 to 100 letters."""
    rows = _bundle(spark, sf_dir).select("faiss_id", F.upper(blank_clean(F.col("ids"))).alias("id"), taxon_name(F.col("tax_order")).alias("tax_order"), contracts.packed(F.slice("embedding", 1, 2)).alias("head"))
    records = table(spark, sf_dir, "bcdm_records").select(F.upper(blank_clean(F.col("processid"))).alias("id"), "record_no", "nuc").where("id IS NOT NULL")
    first = records.groupBy("id").agg(F.min_by(F.struct("nuc"), "record_no").alias("r")).select("id", "r.nuc")
    kept = contracts.length_range(rows.join(first, "id"), "nuc", 50, 100)
    return kept.select("faiss_id", contracts.plain_label(F.concat_ws(":", "tax_order", "id")).alias("label"), F.length("nuc").alias("n"), "head")


def nj_genera(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connector trees of the species of each genus, by the distance of their mean vectors."""
    rows = _bundle(spark, sf_dir).select(taxon_name(F.col("genus")).alias("genus"), taxon_name(F.col("species")).alias("species"), "embedding")
    named = rows.where("genus IS NOT NULL AND species IS NOT NULL").withColumn("path", F.concat_ws("|", "genus", "species"))
    means = R.centroids(named, "path", "embedding").select(F.split("path", r"\|")[0].alias("taxon"), F.col("path").alias("child"), "n", F.col("centroid").alias("rep"))
    return nj.connect(means, "centroid", DIM).drop("share")


def tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "node_lengths")
    return stored("status", rows, lambda: Scratch(spark, "status").keep(hierarchy.hierarchy_status(rows))).groupBy("tree").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(F.col("depth") == 0).alias("n_roots"),
        F.count_if(F.col("fate") != "rooted").alias("n_faulty"),
        F.max("depth").alias("deepest"),
    )


def subtree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of nodes below each node that has any."""
    below = hierarchy.descendants(_measured(spark, sf_dir).paths)
    return below.groupBy("tree", F.col("ancestor_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_below"))


def _measured(spark, sf_dir) -> trees.Measured:
    rows = table(spark, sf_dir, "node_lengths")
    return stored("measured", rows, lambda: trees.Measured(rows))


def _tips(spark, sf_dir):
    """(tree, label, node_id, path): tips whose label is theirs alone in the tree."""
    rows = table(spark, sf_dir, "node_lengths")
    paths = _measured(spark, sf_dir).paths
    labels = rows.where("node_kind = 'tip' AND original_label IS NOT NULL").groupBy("tree", "node_id").agg(F.max("original_label").alias("label"))
    own = labels.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("n"), F.max("node_id").alias("node_id")).where("n = 1")
    return own.join(paths, ["tree", "node_id"]).select("tree", "label", "node_id", "path", "depth")


def lca_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest common ancestor and steps between each labelled tip and another one drawn from its tree."""
    both = pairing.partners(_tips(spark, sf_dir).select("tree", "node_id", "path"), "tree", "node_id")
    shared = F.size(F.filter(F.zip_with("path", "path_2", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda same: same))
    found = both.withColumn("shared", shared).where("shared > 0")
    return found.select("tree", "node_id", "node_id_2", F.get("path", F.col("shared") - 1).alias("lca_id"), (F.size("path") + F.size("path_2") - 2 * F.col("shared")).alias("steps"))


def _purity(spark, sf_dir):
    """Per tree, rank and lineage down to it: its tips, the tips below their last common ancestor, and the share of the one in the other."""
    tips = Scratch(spark, "purity").keep(_tips(spark, sf_dir))
    names = F.struct(*[taxon_name(F.col(r)).alias(r) for r in TAXA])
    records = (
        table(spark, sf_dir, "bcdm_records")
        .select(F.upper(blank_clean(F.col("processid"))).alias("label"), names.alias("taxa"), "record_no")
        .where("label IS NOT NULL")
        .groupBy("label")
        .agg(F.min_by("taxa", "record_no").alias("taxa"))
    )
    shown = [F.coalesce(F.col(f"taxa.{r}"), F.lit("None")) for r in TAXA]
    lineages = F.array(*[F.struct(F.lit(r).alias("rank"), F.concat_ws(" > ", *shown[: i + 1]).alias("lineage")) for i, r in enumerate(TAXA)])
    named = tips.join(records, "label").select("tree", "node_id", "path", F.inline(lineages))
    above = tips.select("tree", F.explode("path").alias("anc"))
    below = above.groupBy("tree", "anc").agg(F.count(F.lit(1)).alias("n_below"))
    # Ancestors that all tips of a taxon have lie on one way; the lowest of them is the common one.
    total = named.groupBy("tree", "rank", "lineage").agg(F.count(F.lit(1)).alias("n_tips"))
    shared = named.select("tree", "rank", "lineage", F.posexplode("path").alias("at", "anc")).groupBy("tree", "rank", "lineage", "anc").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"))
    common = shared.join(total, ["tree", "rank", "lineage"]).where("n = n_tips").groupBy("tree", "rank", "lineage", "n_tips").agg(F.max_by("anc", "at").alias("anc"))
    return common.join(below, ["tree", "anc"]).select("tree", "rank", "lineage", "n_tips", "n_below", (F.col("n_tips") / F.col("n_below")).alias("purity"))


def taxon_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _purity(spark, sf_dir).withColumn("purity", F.round("purity", 6))


def purity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro averages per tree and rank, over all taxa and over those with more than one tip, and how many of the latter are monophyletic."""
    several = F.col("n_tips") > 1
    return _purity(spark, sf_dir).groupBy("tree", "rank").agg(
        F.count(F.lit(1)).alias("n_taxa"), F.count_if(several).alias("n_nontrivial"), F.round(F.avg("purity"), 6).alias("macro_all"),
        F.round(F.avg(F.when(several, F.col("purity"))), 6).alias("macro_nontrivial"), F.count_if(several & (F.col("n_tips") == F.col("n_below"))).alias("n_monophyletic"),
    )


def relation_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten groups of equal size by cosine distance: edges, median and quartiles of the Euclidean one."""
    pairs = _pairs(spark, sf_dir).select("faiss_id", "faiss_id_2", F.round("cosine", 9).alias("x"), F.round("euclid", 9).alias("y"))
    binned = pairs.withColumn("bin", F.ntile(10).over(Window.orderBy("x", "faiss_id", "faiss_id_2")))
    q = {f"q{round(p * 100)}": F.round(F.percentile("y", p), 6) for p in (0.25, 0.5, 0.75)}
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.min("x"), 6).alias("least"), F.round(F.max("x"), 6).alias("most"), *[c.alias(n) for n, c in q.items()])


def rank_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median distances by the first rank that differs."""
    return _pairs(spark, sf_dir).groupBy("first_rank").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.round(F.percentile(F.round("cosine", 9), 0.5), 6).alias("cosine"), F.round(F.percentile(F.round("euclid", 9), 0.5), 6).alias("euclid")
    )


QUERIES = {
    f.__name__: f
    for f in (
        vector_coverage, vector_centroid, centroid_of_centroids, cosine_medoid, genus_medoid, covariance_trace, knn_exact, nearest_centroid,
        vector_pairs, distance_fit, relation_subsets, genus_pairs, record_sample, genus_coverage, rank_medians, one_label_ids, cohort_differences,
        vectors_with_records, nj_genera, tree_summary, subtree_sizes, lca_pairs,
        taxon_purity, purity_summary, relation_bins,
    )
}

_USABLE = """len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
      AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"""
_CELLS = """c AS (SELECT label, i - 1 AS dim, embedding[i]::DOUBLE AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""
_UNIT = "list_transform({v}, lambda x: x::DOUBLE / sqrt(list_sum(list_transform({v}, lambda y: y::DOUBLE * y::DOUBLE))))"


def _sql_medoid(source: str, group: str, key: str) -> str:
    return f"""WITH u AS (SELECT {group} AS g, {key} AS k, {_UNIT.format(v="embedding")} AS u FROM {source}),
      z AS (SELECT g, i, sum(u[i]) AS s FROM (SELECT g, u, unnest(range(1, 65)) AS i FROM u) GROUP BY ALL),
      t AS (SELECT g, list(s ORDER BY i) AS s FROM z GROUP BY g),
      d AS (SELECT u.g, k, round(list_dot_product(u.u, t.s), 9) AS score FROM u JOIN t ON u.g = t.g)
      SELECT g AS {group.split(" ")[-1] if " " not in group else "genus"}, k AS {key}, n FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, k) AS r,
        count(*) OVER (PARTITION BY g) AS n FROM d) WHERE r = 1"""


_TAXA = ", ".join(f"{sql_taxon(r)} AS {r}" for r in TAXA)
_DRAW = "concat('0x', substr(md5({0}), 1, 15))::BIGINT"
_PAIRS = f"""n AS (SELECT *, row_number() OVER (ORDER BY faiss_id) - 1 AS o FROM (SELECT faiss_id, embedding::DOUBLE[] AS e, {_TAXA} FROM embedding_bundle WHERE {_USABLE})),
      tot AS (SELECT count(*) * (count(*) - 1) // 2 AS total FROM n),
      dr AS (SELECT range AS id, {_DRAW.format("'pairs-1:' || range")} % total AS t FROM range({2 * PAIRS}), tot WHERE total > {PAIRS}),
      ts AS (SELECT t FROM (SELECT t, min(id) AS id FROM dr GROUP BY t) ORDER BY id LIMIT {PAIRS}),
      al AS (SELECT t FROM ts UNION ALL SELECT unnest(range(total)) FROM tot WHERE total <= {PAIRS}),
      ro AS (SELECT t, floor((1 + sqrt(1 + 8 * t::DOUBLE)) / 2) AS r FROM al),
      ij AS (SELECT t, (CASE WHEN r * (r - 1) / 2 > t THEN r - 1 WHEN r * (r + 1) / 2 <= t THEN r + 1 ELSE r END)::BIGINT AS j FROM ro),
      p AS (SELECT a.faiss_id, b.faiss_id AS faiss_id_2, 1 - list_cosine_similarity(a.e, b.e) AS cosine, sqrt(greatest(0, 2 - 2 * list_cosine_similarity(a.e, b.e))) AS euclid,
        CASE WHEN a.species = b.species THEN 0 WHEN a.family = b.family AND a.genus = b.genus THEN 1 WHEN a.family = b.family AND a.genus <> b.genus THEN 2
          WHEN a.family <> b.family THEN 3 ELSE 4 END AS relation,
        CASE {" ".join(f"WHEN a.{r} IS DISTINCT FROM b.{r} THEN '{r}'" for r in TAXA)} ELSE 'within_species' END AS first_rank
        FROM ij JOIN n a ON a.o = t - j * (j - 1) // 2 JOIN n b ON b.o = j)"""
_TIPS = f"""{_SQL_WALK}, lab AS (SELECT tree, node_id, max(original_label) AS label FROM node_lengths WHERE node_kind = 'tip' AND original_label IS NOT NULL GROUP BY ALL),
      own AS (SELECT tree, label, max(node_id) AS node_id FROM lab GROUP BY ALL HAVING count(*) = 1),
      tips AS (SELECT own.tree, label, own.node_id, path, steps AS depth, split_part(own.tree, '/', 1) AS run, split_part(own.tree, '/', 2) AS side
               FROM own JOIN s ON s.tree = own.tree AND s.node_id = own.node_id WHERE fate = 'rooted')"""

_PURITY = f"""re AS (SELECT label, arg_min(taxa, record_no) AS taxa FROM (SELECT upper({sql_clean("processid")}) AS label, record_no,
          struct_pack({", ".join(f"{r} := coalesce({sql_taxon(r)}, 'None')" for r in TAXA)}) AS taxa FROM bcdm_records) WHERE label IS NOT NULL GROUP BY label),
        li AS (SELECT tree, node_id, path, unnest([{", ".join(f"struct_pack(rank := '{r}', lineage := concat_ws(' > ', {', '.join(f'taxa.{q}' for q in TAXA[: i + 1])}))" for i, r in enumerate(TAXA))}]) AS l
          FROM tips JOIN re ON re.label = tips.label),
        nm AS (SELECT tree, node_id, path, l.rank AS rank, l.lineage AS lineage FROM li),
        be AS (SELECT tree, anc, count(*) AS n_below FROM (SELECT tree, unnest(path) AS anc FROM tips) GROUP BY ALL),
        tt AS (SELECT tree, rank, lineage, count(*) AS n_tips FROM nm GROUP BY ALL),
        na AS (SELECT tree, rank, lineage, path[i] AS anc, count(*) AS n, max(i) AS i FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM nm) GROUP BY tree, rank, lineage, path[i]),
        co AS (SELECT na.tree, na.rank, na.lineage, n_tips, arg_max(anc, i) AS anc FROM na JOIN tt ON tt.tree = na.tree AND tt.rank = na.rank AND tt.lineage = na.lineage WHERE n = n_tips GROUP BY ALL),
        pu AS (SELECT co.*, n_below FROM co JOIN be ON be.tree = co.tree AND be.anc = co.anc)"""
_PARTNERS = """po AS (SELECT tree, node_id{extra}, row_number() OVER (PARTITION BY tree ORDER BY node_id) - 1 AS o, count(*) OVER (PARTITION BY tree) AS n FROM {source}),
        pt AS (SELECT x.tree, x.node_id AS a, y.node_id AS b, x.*, y.path AS path_2 FROM po x JOIN po y ON x.tree = y.tree
          AND y.o = (x.o + concat('0x', substr(md5('partners-1:' || x.tree || ':' || x.node_id), 1, 15))::BIGINT % (x.n - 1) + 1) % x.n WHERE x.n > 1)"""

SQL = {
    "taxon_purity": f"""{_TIPS}, {_PURITY} SELECT tree, rank, lineage, n_tips, n_below, round(n_tips / n_below, 6) AS purity FROM pu""",
    "purity_summary": f"""{_TIPS}, {_PURITY} SELECT tree, rank, count(*) AS n_taxa, count(*) FILTER (n_tips > 1) AS n_nontrivial, round(avg(n_tips / n_below), 6) AS macro_all,
        round(avg(CASE WHEN n_tips > 1 THEN n_tips / n_below END), 6) AS macro_nontrivial, count(*) FILTER (n_tips > 1 AND n_tips = n_below) AS n_monophyletic FROM pu GROUP BY ALL""",
    "relation_bins": f"""WITH {_PAIRS}, b AS (SELECT round(cosine, 9) AS x, round(euclid, 9) AS y, ntile(10) OVER (ORDER BY round(cosine, 9), faiss_id, faiss_id_2) AS bin FROM p)
        SELECT bin::INT AS bin, count(*) AS n_pairs, round(min(x), 6) AS least, round(max(x), 6) AS most, round(quantile_cont(y, 0.25), 6) AS q25,
        round(quantile_cont(y, 0.5), 6) AS q50, round(quantile_cont(y, 0.75), 6) AS q75 FROM b GROUP BY bin""",
    "rank_medians": f"""WITH {_PAIRS} SELECT first_rank, count(*) AS n_pairs, round(quantile_cont(round(cosine, 9), 0.5), 6) AS cosine,
        round(quantile_cont(round(euclid, 9), 0.5), 6) AS euclid FROM p GROUP BY 1""",
    "relation_subsets": f"""WITH {_PAIRS}, b AS (SELECT mask, round(cosine, 9) AS x, round(euclid, 9) AS y FROM p, (SELECT unnest(range(1, 32)) AS mask) WHERE (mask & (1 << relation)) <> 0),
        k AS (SELECT *, rank() OVER (PARTITION BY mask ORDER BY x) + (count(*) OVER (PARTITION BY mask, x) - 1) / 2 AS rx,
          rank() OVER (PARTITION BY mask ORDER BY y) + (count(*) OVER (PARTITION BY mask, y) - 1) / 2 AS ry FROM b),
        m AS (SELECT mask, count(*) AS n, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN round(corr(x, y), 6) END AS pearson,
          CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN round(corr(rx, ry), 6) END AS spearman, CASE WHEN min(x) < max(x) THEN round(regr_slope(y, x), 6) END AS slope,
          CASE WHEN min(x) < max(x) THEN round(regr_intercept(y, x), 6) END AS intercept,
          CASE WHEN count(*) < 2 THEN 'fewer_than_two_pairs' WHEN min(x) = max(x) OR min(y) = max(y) THEN 'constant_distances' END AS reason FROM k GROUP BY mask)
        SELECT r.mask::INT AS mask, coalesce(n, 0) AS n_pairs, pearson, spearman, slope, intercept, CASE WHEN n IS NULL THEN 'fewer_than_two_pairs' ELSE reason END AS reason
        FROM (SELECT unnest(range(32)) AS mask) r LEFT JOIN m ON m.mask = r.mask""",
    "genus_pairs": f"""WITH u AS (SELECT faiss_id, {sql_taxon("genus")} AS genus, embedding::DOUBLE[] AS e, count(*) OVER (PARTITION BY {sql_taxon("genus")}) AS n FROM embedding_bundle WHERE {_USABLE})
        SELECT a.genus, count(*) AS n_pairs, round(avg(1 - list_cosine_similarity(a.e, b.e)), 6) AS mean_cosine FROM u a JOIN u b ON a.genus = b.genus AND a.faiss_id < b.faiss_id
        WHERE a.n <= 50 GROUP BY 1""",
    "one_label_ids": f"""SELECT upper({sql_clean("ids")}) AS id, count(DISTINCT lower({sql_clean("species")})) AS n_labels, min({sql_clean("species")}) AS species
        FROM embedding_bundle WHERE {sql_clean("ids")} IS NOT NULL GROUP BY 1""",
    "cohort_differences": f"""WITH r AS (SELECT id, genus FROM (SELECT upper({sql_clean("processid")}) AS id, {sql_taxon("genus")} AS genus, row_number() OVER (PARTITION BY upper({sql_clean("processid")}) ORDER BY record_no) AS k FROM bcdm_records) WHERE k = 1 AND id IS NOT NULL),
        b AS (SELECT id, genus FROM (SELECT upper({sql_clean("ids")}) AS id, {sql_taxon("genus")} AS genus, row_number() OVER (PARTITION BY upper({sql_clean("ids")}) ORDER BY faiss_id) AS k FROM embedding_bundle) WHERE k = 1 AND id IS NOT NULL)
        SELECT problem, count(*) AS n FROM (SELECT CASE WHEN r.id IS NULL THEN 'only_second' WHEN b.id IS NULL THEN 'only_first' WHEN r.genus IS DISTINCT FROM b.genus THEN 'label_differs' END AS problem
          FROM r FULL JOIN b ON r.id = b.id) WHERE problem IS NOT NULL GROUP BY 1""",
    "record_sample": f"SELECT faiss_id, ids, bundle_no FROM embedding_bundle WHERE {_USABLE} ORDER BY md5('rows-1:' || faiss_id), faiss_id LIMIT 200",
    "genus_coverage": f"""WITH s AS (SELECT faiss_id FROM embedding_bundle WHERE {_USABLE} ORDER BY md5('rows-1:' || faiss_id), faiss_id LIMIT 200),
        k AS (SELECT DISTINCT upper({sql_clean("processid")}) AS id FROM bcdm_records)
        SELECT {sql_taxon("family")} AS family, {sql_taxon("genus")} AS genus, count(*) AS n_eligible, count(k.id) AS n_matched, count(s.faiss_id) AS n_analysed
        FROM embedding_bundle b LEFT JOIN k ON k.id = upper({sql_clean("ids")}) LEFT JOIN s ON s.faiss_id = b.faiss_id
        WHERE {_USABLE} AND {sql_taxon("family")} IS NOT NULL AND {sql_taxon("genus")} IS NOT NULL GROUP BY 1, 2""",
    "vector_coverage": f"""SELECT CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'dimensions' WHEN NOT ({_USABLE}) THEN 'not_usable'
        WHEN {sql_taxon("species")} IS NULL THEN 'no_species' ELSE 'kept' END AS reason, count(*) AS n_rows FROM embedding_bundle GROUP BY 1""",
    "vector_centroid": f"WITH {_CELLS} SELECT label, dim, count(*) AS n, round(sum(x) / count(*), 6) AS mean FROM c GROUP BY ALL",
    "centroid_of_centroids": f"""WITH r AS (SELECT {", ".join(f"{sql_taxon(r)} AS {r}" for r in TAXA[1:])}, {_UNIT.format(v="embedding")} AS u FROM embedding_bundle WHERE {_USABLE}),
        e AS (SELECT family, genus, species, i - 1 AS dim, u[i] AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM r WHERE family IS NOT NULL AND genus IS NOT NULL AND species IS NOT NULL)),
        s0 AS (SELECT family, genus, species, dim, avg(x) AS x FROM e GROUP BY ALL), s1 AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY family, genus, species)) AS y FROM s0),
        g0 AS (SELECT family, genus, dim, avg(y) AS x FROM s1 GROUP BY ALL), g1 AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY family, genus)) AS y FROM g0),
        f0 AS (SELECT family, dim, avg(y) AS x FROM g1 GROUP BY ALL)
        SELECT family, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY family)), 6) AS x FROM f0""",
    "cosine_medoid": _sql_medoid("embeddings", "label", "vec_id"),
    "genus_medoid": _sql_medoid(f"(SELECT *, {sql_taxon('genus')} AS clean FROM embedding_bundle WHERE {_USABLE} AND {sql_taxon('genus')} IS NOT NULL)", "clean", "faiss_id").replace("g AS clean,", "g AS genus,"),
    "covariance_trace": f"""WITH {_CELLS}, d AS (SELECT label, dim, var_samp(x) AS v, avg(x) AS m FROM c GROUP BY ALL)
        SELECT label, round(sum(v), 6) AS trace, round(sqrt(sum(m * m)), 6) AS norm FROM d GROUP BY 1""",
    "knn_exact": """WITH d AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s
          FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM d)
        SELECT query, id, rank, round(s, 6) AS similarity FROM r WHERE rank <= 5""",
    "nearest_centroid": f"""WITH {_CELLS}, m AS (SELECT label, list(x ORDER BY dim) AS m FROM (SELECT label, dim, avg(x) AS x FROM c GROUP BY ALL) GROUP BY 1)
        SELECT vec_id, label AS nearest FROM (SELECT e.vec_id, m.label, row_number() OVER (PARTITION BY e.vec_id
          ORDER BY round(1 - list_cosine_similarity(e.embedding::DOUBLE[], m.m), 9), m.label) AS k FROM embeddings e, m) WHERE k = 1""",
    "vector_pairs": f"WITH {_PAIRS} SELECT faiss_id, faiss_id_2, round(cosine, 6) AS cosine, round(euclid, 6) AS euclid, relation, first_rank FROM p",
    "distance_fit": f"""WITH {_PAIRS}, q AS (SELECT round(cosine, 9) AS t, round(euclid, 9) AS f, first_rank FROM p), b AS (SELECT * FROM q UNION ALL SELECT t, f, 'all' FROM q),
        k AS (SELECT *, rank() OVER (PARTITION BY first_rank ORDER BY t) + (count(*) OVER (PARTITION BY first_rank, t) - 1) / 2 AS rx,
          rank() OVER (PARTITION BY first_rank ORDER BY f) + (count(*) OVER (PARTITION BY first_rank, f) - 1) / 2 AS ry FROM b),
        g AS (SELECT first_rank AS g, greatest(0, sum(t * f) / sum(f * f)) AS scale FROM b GROUP BY 1)
        SELECT first_rank, count(*) AS n_pairs, round(sqrt(sum((f - t) * (f - t)) / sum(t * t)), 6) AS stress, round(avg(f - t), 6) AS mean_error,
        round(avg(abs(f - t)), 6) AS mean_abs_error, round(quantile_cont(abs(f - t), 0.9), 6) AS p90_abs_error, round(avg(CASE WHEN t > 0 THEN abs(f - t) / t END) * 100, 6) AS mape,
        count(*) FILTER (t = 0) AS n_zero_targets, round(any_value(scale), 6) AS scale, round(sqrt(sum((scale * f - t) * (scale * f - t)) / sum(t * t)), 6) AS scaled_stress,
        round(corr(t, f), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM k JOIN g ON g = first_rank GROUP BY first_rank""",
    "tree_summary": f"""{_SQL_WALK} SELECT tree, count(*) AS n_nodes, count(*) FILTER (fate = 'rooted' AND steps = 0) AS n_roots,
        count(*) FILTER (fate <> 'rooted') AS n_faulty, max(CASE WHEN fate = 'rooted' THEN steps END)::BIGINT AS deepest FROM s GROUP BY 1""",
    "subtree_sizes": f"""{_SQL_WALK} SELECT tree, path[i] AS node_id, count(*) AS n_below
        FROM (SELECT *, unnest(range(1, steps + 1)) AS i FROM s WHERE fate = 'rooted') GROUP BY ALL""",
    "lca_pairs": f"""{_TIPS}, {_PARTNERS.format(source="tips", extra=", path")},
        k AS (SELECT *, len(list_filter(range(1, least(len(p), len(q)) + 1), lambda i: p[i] = q[i])) AS shared FROM (SELECT tree, a, b, path AS p, path_2 AS q FROM pt))
        SELECT tree, a AS node_id, b AS node_id_2, p[shared] AS lca_id, (len(p) + len(q) - 2 * shared)::INT AS steps FROM k WHERE shared > 0""",
}
