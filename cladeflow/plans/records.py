"""Queries on barcode records: cleaning, selection, taxonomy, sets, keys and sequences, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeflow.functions import seq
from cladeflow.functions.text import UNKNOWN_SPECIES, bin_name, blank_clean, collapse, taxon_name
from cladeflow.operators import selection, taxonomy
from cladeflow.plans.problems import sql_bin, sql_clean, sql_taxon
from cladeflow.session import Scratch, stored, table

RANKS = taxonomy.RANKS
SHORT_PRIMERS = seq.Primers("short", "GGWAC", "GGYAA", 60, 20, 120)
FUZZY_PRIMERS = seq.Primers("mid", "GGWACTGATTAG", "GGYAACCATCCA", 60, 20, 120)
GATES = selection.Gates(*selection.parse_taxon("phylum:Basyptata"), "COI-5P", 60, 0.02, selection.parse_crop("2:90"))
SHARDS = 8


def _records(spark, sf_dir):
    return table(spark, sf_dir, "bcdm_records")


def null_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(r).alias("rank"), blank_clean(F.col(r)).alias("v")) for r in RANKS])
    return (
        _records(spark, sf_dir)
        .select(F.explode(cells).alias("c"))
        .groupBy("c.rank")
        .agg(F.count_if(F.col("c.v").isNull()).alias("n_missing"), F.count_distinct("c.v").alias("n_spellings"))
    )


def marker_rank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker as written, taxon in any letter case."""
    rows = _records(spark, sf_dir).where((F.col("marker_code") == "COI-5P") & (F.lower(collapse(F.col("phylum"))) == "basyptata"))
    return rows.groupBy(taxon_name(F.col("tax_order")).alias("tax_order")).agg(F.count(F.lit(1)).alias("n_rows"))


def drop_reason_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a phylum and marker by the first gate they fail at."""
    rows = selection.assessed(_records(spark, sf_dir), GATES, SHORT_PRIMERS)
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def selection_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in scope, the BINs they name, and how many name a taxon of the next rank."""
    rows = selection.in_scope(_records(spark, sf_dir), GATES)
    child = blank_clean(F.col(selection.child_rank(GATES.rank)))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(bin_name(F.col("bin_uri"))).alias("n_bins"), F.count(child).alias("n_children"))


def child_rank_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten taxa of the next rank with most rows in scope."""
    child = blank_clean(F.col(selection.child_rank(GATES.rank)))
    counts = selection.in_scope(_records(spark, sf_dir), GATES).groupBy(child.alias("child")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.where("child IS NOT NULL").orderBy(F.desc("n_rows"), "child").limit(10)


def window_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = selection.score_records(_records(spark, sf_dir), SHORT_PRIMERS)
    return scored.where("metrics IS NOT NULL").select("record_no", "metrics.*")


def window_assess_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = selection.score_records(_records(spark, sf_dir), FUZZY_PRIMERS, 2)
    return scored.where("metrics IS NOT NULL").select("record_no", "metrics.*")


def primer_set_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the published primer sets meet the records: support and coverage rank."""
    cleaned = _records(spark, sf_dir).select(seq.clean_sequence(F.col("nuc")).alias("s")).where("s IS NOT NULL")
    parts = [
        seq.assess_window(cleaned, "s", p, 2)
        .groupBy(F.lit(name).alias("primer_set"), "metrics.primer_support", "metrics.coverage_rank", "metrics.primer_mismatches")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        for name, p in seq.PRIMER_SETS.items()
    ]
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    return everything


def bin_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best record of each BIN among those that pass all gates, with its window."""
    return selection.representatives(_records(spark, sf_dir), GATES, SHORT_PRIMERS)


def representative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representatives as rows of the dump with seven derived columns, in order of the BIN."""
    rows = selection.representative_rows(_records(spark, sf_dir), bin_representatives(spark, sf_dir), SHORT_PRIMERS)
    return rows.drop("ingested_at")


def window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = bin_representatives(spark, sf_dir)
    return best.groupBy("primer_support").agg(
        F.count(F.lit(1)).alias("n_bins"),
        F.min("window_length").alias("shortest"),
        F.max("window_length").alias("longest"),
        F.round(F.avg("window_length"), 6).alias("mean_length"),
        F.round(F.avg("ambiguity_fraction"), 6).alias("mean_ambiguity"),
    )


def best_sequence_per_specimen(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = seq.clean_sequence(F.col("nuc"))
    acgt = F.length(cleaned) - seq.ambiguity_count(cleaned)
    rows = _records(spark, sf_dir).select(F.upper(blank_clean(F.col("processid"))).alias("specimen"), "record_no", acgt.alias("acgt")).where(
        "specimen IS NOT NULL AND acgt IS NOT NULL"
    )
    return rows.groupBy("specimen").agg(F.max_by("record_no", F.struct("acgt", -F.col("record_no"))).alias("record_no"), F.max("acgt").alias("acgt"))


def revcomp_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = seq.clean_sequence(F.col("nuc"))
    return _records(spark, sf_dir).select("record_no", seq.reverse_complement(cleaned).alias("revcomp"), seq.ambiguity_count(cleaned).alias("n_ambiguous"))


def seq_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence distances within each BIN: its records whose number is divisible by 20 against all others of it."""
    rows = _records(spark, sf_dir).select(bin_name(F.col("bin_uri")).alias("bin_uri"), "record_no", seq.clean_sequence(F.col("nuc")).alias("s")).where("bin_uri IS NOT NULL AND s IS NOT NULL")
    counted = seq.site_counts_within_groups(rows, "bin_uri", "record_no", "s", 20)
    models = ("p", "jc69", "k2p")
    d = [seq.distance(F.struct("sites", "ts", "tv"), m, 20).alias(m) for m in models]
    measured = counted.select("bin_uri", "n", "sites", *d)
    mean = lambda m: F.sum(F.col(m) * F.col("n")) / F.sum(F.when(F.col(m).isNotNull(), F.col("n")))
    return measured.groupBy("bin_uri").agg(
        F.sum("n").alias("n_pairs"), F.sum(F.col("sites") * F.col("n")).alias("sites"), *[F.round(mean(m), 6).alias(f"mean_{m}") for m in models], F.round(F.max("k2p"), 6).alias("most_k2p")
    )


def _counts(spark, sf_dir):
    return taxonomy.lineage_counts(_records(spark, sf_dir))


def _path_rows(rows):
    return rows.withColumn("path", taxonomy.path_text(F.col("path")))


def _parent_columns(votes):
    taxon, parent = F.col("taxon"), F.col("parent")
    return votes.select(
        taxonomy.rank_no(taxon).alias("rank_no"), taxonomy.name(taxon).alias("name"),
        taxonomy.rank_no(parent).alias("parent_rank"), taxonomy.name(parent).alias("parent_name"), "votes",
    )


def lineage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path_rows(_counts(spark, sf_dir))


def subtree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path_rows(taxonomy.subtree_counts(_counts(spark, sf_dir)))


def distinct_taxa_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = taxonomy.subtree_counts(_counts(spark, sf_dir))
    low = taxonomy.rank_no(F.element_at(taxonomy.taxa(F.col("path")), -1))
    return prefixes.groupBy(low.alias("rank_no")).agg(F.count(F.lit(1)).alias("n_taxa"), F.sum("n_records").alias("n_records"))


def parent_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parent_columns(taxonomy.parent_votes(_counts(spark, sf_dir)))


def _parents(counts):
    return taxonomy.canonical_parents(taxonomy.parent_votes(counts))


def canonical_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parent_columns(_parents(_counts(spark, sf_dir)))


def dissolved_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineages of the records that the reconciled hierarchy doesn't have."""
    counts = Scratch(spark, "lineages").keep(_counts(spark, sf_dir))
    kept = taxonomy.reconciled_chains(_parents(counts)).select(F.col("chain").alias("path"))
    return _path_rows(taxonomy.subtree_counts(counts).join(kept, "path", "left_anti"))


def reconciled_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = taxonomy.reconciled_chains(_parents(_counts(spark, sf_dir)))
    return c.select(taxonomy.rank_no(F.col("taxon")).alias("rank_no"), taxonomy.name(F.col("taxon")).alias("name"), taxonomy.path_text(F.col("chain")).alias("path"))


class _Placement:
    """BINs, their candidates and the chains of all taxa, from one pass over the records."""

    def __init__(self, spark, sf_dir):
        observed = Scratch(spark, "observed").keep(taxonomy.observations(_records(spark, sf_dir), bin_name(F.col("bin_uri"))))
        counts = observed.groupBy("path").agg(F.sum("n_records").alias("n_records"))
        self.chains = taxonomy.reconciled_chains(_parents(counts))
        self.candidates = taxonomy.terminal_candidates(observed)

    def placed(self, policy):
        return taxonomy.place_terminals(taxonomy.resolve_candidates(self.candidates, self.chains), self.chains, policy)

    def sidecar(self, style="colon"):
        return taxonomy.sidecar(self.candidates, self.placed("lca"), "BIN", style)


def _placement(spark, sf_dir) -> _Placement:
    return stored("placement", _records(spark, sf_dir), lambda: _Placement(spark, sf_dir))


def _placed_text(placed):
    return placed.select(F.col("terminal").alias("bin_uri"), taxonomy.path_text(F.col("attachment")).alias("path"), "n_candidates", "lifted", "suspect")


def lca_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed_text(_placement(spark, sf_dir).placed("lca"))


def plurality_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed_text(_placement(spark, sf_dir).placed("plurality"))


def lift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.lift_summary(_placement(spark, sf_dir).placed("lca"))


def sidecar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placement(spark, sf_dir).sidecar()


def placement_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.annotation(_placement(spark, sf_dir).sidecar("gtdb"))


def sidecar_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.sidecar_summary(Scratch(spark, "sidecar").keep(_placement(spark, sf_dir).sidecar()))


def top_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most fragmented suspects."""
    rows = _placement(spark, sf_dir).sidecar().where("suspect = 'yes'")
    return rows.select("terminal", "n_lineages", "placed_at").orderBy(F.desc("n_lineages"), F.desc("terminal")).limit(10)


def grafted_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxa that carry a terminal below them, with the number of their terminals."""
    placed = _placement(spark, sf_dir).placed("lca")
    at = placed.groupBy(F.col("attachment").alias("path")).agg(F.count(F.lit(1)).alias("n_records"))
    return _path_rows(taxonomy.subtree_counts(at)).withColumnRenamed("n_records", "n_terminals")


def top_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest families, all others as one."""
    counts = _records(spark, sf_dir).groupBy(taxon_name(F.col("family")).alias("family")).agg(F.count(F.lit(1)).alias("n")).where("family IS NOT NULL")
    top = counts.orderBy(F.desc("n"), "family").limit(20).select("family", F.lit(True).alias("top"))
    return counts.join(top, "family", "left").groupBy(F.when(F.col("top"), F.col("family")).otherwise("Other").alias("family")).agg(F.sum("n").alias("n_rows"))


def _specimens(spark, sf_dir):
    records = _records(spark, sf_dir).select(F.upper(blank_clean(F.col("processid"))).alias("id")).where("id IS NOT NULL").distinct()
    bundle = table(spark, sf_dir, "embedding_bundle").select(F.upper(blank_clean(F.col("ids"))).alias("id")).where("id IS NOT NULL").distinct()
    return records, bundle


def align_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, bundle = _specimens(spark, sf_dir)
    both = records.withColumn("r", F.lit(1)).join(bundle.withColumn("b", F.lit(1)), "id", "full")
    reason = F.when(F.col("r").isNull(), "missing_from_records").when(F.col("b").isNull(), "missing_from_bundle").otherwise("shared")
    return both.groupBy(reason.alias("coverage")).agg(F.count(F.lit(1)).alias("n_ids"))


def shared_specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, bundle = _specimens(spark, sf_dir)
    return records.intersect(bundle)


def bundle_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, bundle = _specimens(spark, sf_dir)
    return bundle.join(records, "id", "left_anti")


def label_map_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family names under the order most of their records name, themselves if none does."""
    rows = _records(spark, sf_dir).select(taxon_name(F.col("family")).alias("label"), taxon_name(F.col("tax_order")).alias("o")).where("label IS NOT NULL")
    votes = rows.where("o IS NOT NULL").groupBy("label", "o").agg(F.count(F.lit(1)).alias("n"))
    mapping = votes.groupBy("label").agg(F.min_by("o", F.struct(-F.col("n"), F.col("o"))).alias("taxon"))
    return rows.select("label").distinct().join(mapping, "label", "left").select("label", F.coalesce("taxon", "label").alias("taxon"))


def duplicate_specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _records(spark, sf_dir)
        .groupBy(F.upper(blank_clean(F.col("processid"))).alias("id"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where("id IS NOT NULL AND n_rows > 1")
    )


def _species_keys(spark, sf_dir):
    name = F.lower(collapse(F.col("species")))
    known = _records(spark, sf_dir).select(name.alias("species")).where(F.col("species").isNotNull() & ~F.col("species").isin(*UNKNOWN_SPECIES))
    slug = F.substring(F.regexp_replace(F.regexp_replace("species", "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)
    return known.groupBy("species").agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "species_key", F.concat(slug, F.lit("-"), F.substring(F.sha2("species", 256), 1, 10))
    )


def species_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _species_keys(spark, sf_dir).select("species", "species_key", "n_rows")


def species_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.conv(F.substring(F.sha2("species_key", 256), 1, 16), 16, 10).cast("decimal(20,0)")
    keyed = _species_keys(spark, sf_dir).withColumn("shard", F.pmod(head, F.lit(SHARDS).cast("decimal(20,0)")).cast("int"))
    return keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_species"), F.sum("n_rows").alias("n_rows"))


def header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers ``id|k:..|p:..|c:..`` of the records, written and read again."""
    parts = [F.concat(F.lit(f"{p}="), F.coalesce(taxon_name(F.col(c)), F.lit("None"))) for p, c in (("kingdom", "kingdom"), ("phylum", "phylum"), ("class", "tax_class"), ("family", "family"))]
    header = _records(spark, sf_dir).select("record_no", F.concat_ws("|", F.coalesce("processid", F.lit("")), *parts).alias("header"))
    field = lambda n: F.nullif(F.regexp_extract("header", rf"(?i)(?:^|\|){n}[=:]([^|]*)", 1), F.lit("None"))
    return header.select("record_no", field("class").alias("tax_class"), field("family").alias("family"))


def genus_family_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genera with the number of families their records name; one if the family follows from the genus."""
    rows = _records(spark, sf_dir).select(taxon_name(F.col("genus")).alias("genus"), taxon_name(F.col("family")).alias("family"))
    return rows.where("genus IS NOT NULL AND family IS NOT NULL").groupBy("genus").agg(F.count_distinct("family").alias("n_families"), F.min("family").alias("first_family"))


def event_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the same user, type and payload are delivered once: the first by time."""
    events = table(spark, sf_dir, "events")
    fingerprint = F.substring(F.sha2(F.concat_ws("\n", F.col("user_id").cast("string"), "event_type", "props"), 256), 1, 12)
    return events.groupBy(fingerprint.alias("fingerprint")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("n_delivered"))


def release_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartile groups of sequence length by rank position within the release, with mean length."""
    rows = _records(spark, sf_dir).where("nuc IS NOT NULL AND release_tag IS NOT NULL").select("release_tag", F.length("nuc").alias("n"), "record_no")
    w = Window.partitionBy("release_tag").orderBy("n", "record_no")
    return rows.withColumn("bin", F.ntile(4).over(w)).groupBy("release_tag", "bin").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("n_rows"))


QUERIES = {
    f.__name__: f
    for f in (
        null_clean, marker_rank_filter, drop_reason_accounting, selection_counters, child_rank_counts, window_assess, window_assess_fuzzy,
        primer_set_support, bin_representatives, representative_rows, window_summary,
        best_sequence_per_specimen, revcomp_ambiguity, seq_distance, lineage_counts, subtree_rollup, distinct_taxa_by_prefix, parent_votes,
        canonical_parent, dissolved_taxa, reconciled_chain, lca_placement, plurality_placement, lift_summary, sidecar_rows,
        placement_annotation, sidecar_summary, top_suspects, grafted_lineages, top_families, align_coverage, shared_specimens, bundle_only, label_map_coalesce, duplicate_specimens, species_key,
        species_shard, header_parse, genus_family_map, event_idempotent, release_bins,
    )
}

_SEQ = "upper(regexp_replace(nuc, '[^A-Za-z]', '', 'g'))"
_SPECIMEN = f"upper({sql_clean('processid')})"
_COLLAPSED = "trim(regexp_replace({0}, '" + r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+" + "', ' ', 'g'))"


def _sql_exact(primer: str, text: str) -> str:
    """Place (from 0) and mismatches of the leftmost exact fit."""
    p = seq.iupac_regex(primer)
    return f"CASE WHEN regexp_matches({text}, '{p}') THEN struct_pack(a := strpos({text}, regexp_extract({text}, '{p}')) - 1, m := 0) END"


def _sql_fuzzy(primer: str, text: str, most: int = 2) -> str:
    """The same with mismatches, an exact fit first: the least of mismatches or none, then place."""
    letters = [seq.IUPAC.get(c, c) for c in primer]
    missed = " + ".join(f"(instr('{fit}', substr({text}, p::INT + {k}, 1)) = 0)::INT" for k, fit in enumerate(letters, 1))
    hits = f"list_filter(list_transform(range(length({text}) - {len(letters) - 1}), lambda p: struct_pack(z := ({missed}) > 0, a := p, m := {missed})), lambda h: h.m <= {most})"
    return f"list_min({hits})"


def _sql_window(p: seq.Primers = SHORT_PRIMERS, source: str = "bcdm_records", find=None) -> str:
    find = find or _sql_exact
    back = seq.reverse_complement_text(p.reverse) if p.reverse else ""
    hit = lambda primer, text: find(primer, text) if primer else "NULL::STRUCT(a BIGINT, m INTEGER)"
    nf = len(p.forward)
    top = "both" if p.reverse else "forward_only"
    return f"""s AS (SELECT record_no, {sql_bin("bin_uri")} AS bin_uri, {_SEQ} AS s FROM {source}),
      f AS (SELECT *, {hit(p.forward, "s")} AS f FROM s WHERE s IS NOT NULL),
      f2 AS (SELECT *, f.a + {nf} AS fe, substr(s, f.a + {nf} + 1) AS tail FROM f),
      r1 AS (SELECT *, {hit(back, "tail")} AS rb, {hit(back, "s")} AS rc FROM f2),
      r AS (SELECT *, coalesce(fe + rb.a, rc.a) AS r0, CASE WHEN rb IS NOT NULL THEN rb.m ELSE rc.m END AS rm FROM r1),
      b AS (SELECT *, CASE WHEN f IS NOT NULL AND r0 IS NOT NULL AND r0 > fe THEN 'both' WHEN f IS NOT NULL THEN 'forward_only'
              WHEN r0 IS NOT NULL THEN 'reverse_only' ELSE 'none' END AS primer_support FROM r),
      w AS (SELECT *, CASE primer_support WHEN 'both' THEN f.m + rm WHEN 'forward_only' THEN f.m WHEN 'reverse_only' THEN rm ELSE 0 END AS primer_mismatches,
              CASE WHEN f IS NOT NULL THEN fe ELSE 0 END AS window_start,
              CASE WHEN primer_support IN ('both', 'reverse_only') THEN r0 ELSE length(s) END AS window_end FROM b),
      v AS (SELECT *, window_end - window_start AS window_length,
              length(regexp_replace(substr(s, window_start + 1, window_end - window_start), '[ACGT]', '', 'g')) AS ambiguity_count FROM w),
      m AS (SELECT record_no, bin_uri, s, primer_support, primer_mismatches,
              CASE WHEN primer_support = '{top}' AND window_length BETWEEN {p.shortest} AND {p.longest} THEN 0 WHEN primer_support = '{top}' THEN 1
                   WHEN primer_support <> 'none' AND {bool(p.reverse)} THEN 2 ELSE 3 END AS coverage_rank,
              window_start, window_end, window_length, ambiguity_count,
              CASE WHEN window_length > 0 THEN ambiguity_count / window_length ELSE 1.0 END AS ambiguity_fraction,
              CASE WHEN primer_support = 'none' THEN -window_length ELSE abs(window_length - {p.target}) END AS tiebreak_length FROM v)"""


def _sql_selection() -> str:
    scope = f"(SELECT * FROM bcdm_records WHERE lower({sql_clean(GATES.rank)}) = '{GATES.taxon}' AND {sql_clean('marker_code')} = '{GATES.marker}')"
    raw = sql_clean("nuc")
    first, last = GATES.crop
    return f"""g AS {scope}, g2 AS (SELECT * REPLACE ({raw} AS nuc) FROM g), {_sql_window(SHORT_PRIMERS, "(SELECT * REPLACE (nullif(regexp_replace(nuc, '[^A-Za-z]', '', 'g'), '') AS nuc) FROM g2)")},
      o AS (SELECT g2.record_no, {sql_bin("g2.bin_uri")} AS bin_uri, g2.nuc, m.* EXCLUDE (record_no, bin_uri),
              substr(substr(m.s, window_start + 1, window_length), {first + 1}, {last - first}) AS output_sequence FROM g2 LEFT JOIN m ON m.record_no = g2.record_no),
      a AS (SELECT *, CASE WHEN bin_uri IS NULL THEN 'missing_bin' WHEN nuc IS NULL THEN 'missing_sequence' WHEN s IS NULL THEN 'empty_after_clean'
              WHEN length(s) < {GATES.shortest} THEN 'below_min_sequence_length' WHEN ambiguity_fraction > {GATES.most_ambiguous} THEN 'too_ambiguous'
              WHEN length(output_sequence) = 0 THEN 'empty_after_crop' END AS reason FROM o),
      best AS (SELECT * EXCLUDE (k, s, nuc, reason) FROM (SELECT *, row_number() OVER (PARTITION BY bin_uri ORDER BY coverage_rank, primer_mismatches, tiebreak_length,
              ambiguity_fraction, ambiguity_count, -window_length, record_no) AS k FROM a WHERE reason IS NULL) WHERE k = 1)"""


def _sql_chain() -> str:
    cells = ", ".join(f"CASE WHEN {sql_taxon(r)} IS NOT NULL THEN '{i}:' || {sql_taxon(r)} END" for i, r in enumerate(RANKS))
    return f"""c AS (SELECT list_filter([{cells}], lambda x: x IS NOT NULL) AS chain, {sql_bin("bin_uri")} AS terminal FROM bcdm_records),
      l AS (SELECT chain, count(*) AS n FROM c GROUP BY chain),
      sub AS (SELECT chain[1:i] AS chain, sum(n)::BIGINT AS n FROM (SELECT *, unnest(range(1, len(chain) + 1)) AS i FROM l) GROUP BY ALL),
      v AS (SELECT chain[i] AS taxon, CASE WHEN i > 1 THEN chain[i - 1] END AS parent, sum(n)::BIGINT AS votes
            FROM (SELECT *, unnest(range(1, len(chain) + 1)) AS i FROM l) GROUP BY ALL),
      p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY coalesce(split_part(parent, ':', 1)::INT, -1) DESC, votes DESC,
            split_part(parent, ':', 2) NULLS FIRST) AS k FROM v) WHERE k = 1),
      g AS (SELECT taxon, [taxon] AS chain FROM p WHERE parent IS NULL
            UNION ALL SELECT p.taxon, list_append(g.chain, p.taxon) FROM p JOIN g ON p.parent = g.taxon),
      t AS (SELECT terminal, chain[-1] AS taxon, count(*) AS votes FROM c WHERE terminal IS NOT NULL AND len(chain) > 0 GROUP BY ALL),
      d AS (SELECT terminal, g.chain, sum(votes)::BIGINT AS votes FROM t JOIN g USING (taxon) GROUP BY ALL),
      k0 AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.terminal = d.terminal AND len(e.chain) > len(d.chain)
            AND e.chain[1:len(d.chain)] = d.chain)),
      k AS (SELECT k0.terminal, chain, n_candidates, CASE WHEN n_candidates = 1 THEN total ELSE votes END AS votes FROM k0
            JOIN (SELECT terminal, count(*) AS n_candidates FROM k0 GROUP BY 1) USING (terminal)
            JOIN (SELECT terminal, sum(votes)::BIGINT AS total FROM d GROUP BY 1) USING (terminal)),
      lca AS (SELECT terminal, n_candidates, coalesce(max(CASE WHEN same THEN i END), 0) AS depth FROM
            (SELECT terminal, n_candidates, i, count(DISTINCT chain[1:i]) = 1 AND min(len(chain)) >= i AS same
             FROM k, range(1, 12) r(i) GROUP BY terminal, n_candidates, i) GROUP BY terminal, n_candidates),
      placed AS (SELECT lca.terminal, lca.n_candidates, any_value(k.chain)[1:lca.depth] AS attachment FROM lca JOIN k ON k.terminal = lca.terminal GROUP BY lca.terminal, lca.n_candidates, lca.depth),
      q AS (SELECT *, n_candidates > 1 AS lifted, n_candidates > 1 AND coalesce(split_part(attachment[-1], ':', 1)::INT, -1) <= 4 AS suspect FROM placed)"""


_REC = f"WITH RECURSIVE {_sql_chain()}"
_SPLIT = "split_part({0}, ':', 1)::INT"
_WORD = f"list_extract({list(taxonomy.RANK_WORDS)}, split_part({{0}}, ':', 1)::INT + 1)"
_BRACES = "(CASE WHEN contains({0}, '|') THEN '{{' || replace({0}, '|', ',') || '}}' ELSE {0} END)"


def _sql_sidecar(style: str) -> str:
    prefix = f"list_extract({list(taxonomy.RANK_PREFIXES)}, split_part({{0}}, ':', 1)::INT + 1) || '__' || replace(split_part({{0}}, ':', 2), ' ', '_')"
    label = prefix if style == "gtdb" else f"{_WORD} || ':' || split_part({{0}}, ':', 2)"
    order = f"ORDER BY votes DESC, {_WORD.format('taxon')}, split_part(taxon, ':', 2)"
    return f"""SELECT t.terminal, 'BIN' AS rank, coalesce({label.format("any_value(q.attachment)[-1]")}, 'root') AS placed_at,
        CASE WHEN any_value(lifted) THEN 'yes' ELSE 'no' END AS lifted, CASE WHEN any_value(suspect) THEN 'yes' ELSE 'no' END AS suspect,
        count(*)::INT AS n_lineages, sum(votes)::BIGINT AS records, string_agg({label.format("taxon")}, '|' {order}) AS lineages,
        string_agg(votes::VARCHAR, '|' {order}) AS counts FROM t JOIN q ON q.terminal = t.terminal GROUP BY t.terminal"""


_PARENT_COLUMNS = f"""{_SPLIT.format("taxon")} AS rank_no, split_part(taxon, ':', 2) AS name, {_SPLIT.format("parent")} AS parent_rank,
      CASE WHEN parent IS NOT NULL THEN split_part(parent, ':', 2) END AS parent_name, votes"""
_KEYED = f"""s AS (SELECT lower({_COLLAPSED.replace("{0}", "species")}) AS species FROM bcdm_records),
      k AS (SELECT species, count(*) AS n_rows, substr(regexp_replace(regexp_replace(species, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80)
              || '-' || substr(sha256(species), 1, 10) AS species_key FROM s
            WHERE species NOT IN {UNKNOWN_SPECIES} GROUP BY species)"""
_SITES = f"""s AS (SELECT record_no, {sql_bin("bin_uri")} AS bin_uri, {_SEQ} AS s FROM bcdm_records),
      j AS (SELECT a.bin_uri, a.record_no AS a, b.record_no AS b, a.s, b.s AS t FROM s a JOIN s b ON a.bin_uri = b.bin_uri AND a.record_no % 20 = 0
            AND (b.record_no > a.record_no OR b.record_no < a.record_no AND b.record_no % 20 <> 0) WHERE a.s IS NOT NULL AND b.s IS NOT NULL),
      x AS (SELECT bin_uri, a, b, substr(s, i, 1) AS x, substr(t, i, 1) AS y FROM (SELECT *, unnest(range(1, greatest(2, least(length(s), length(t)) + 1))) AS i FROM j)),
      c AS (SELECT bin_uri, a, b, count(*) FILTER (x IN ('A','C','G','T') AND y IN ('A','C','G','T')) AS sites,
              count(*) FILTER (x || y IN ('AG','GA','CT','TC')) AS ts,
              count(*) FILTER (x <> y AND x IN ('A','C','G','T') AND y IN ('A','C','G','T') AND x || y NOT IN ('AG','GA','CT','TC')) AS tv FROM x GROUP BY ALL),
      e AS (SELECT *, ts / sites AS p, tv / sites AS q FROM c),
      d AS (SELECT bin_uri, sites, CASE WHEN sites >= 20 THEN p + q END AS p,
              CASE WHEN sites >= 20 AND 1 - 4 * (p + q) / 3 > 0 THEN -0.75 * ln(1 - 4 * (p + q) / 3) END AS jc69,
              CASE WHEN sites >= 20 AND 1 - 2 * p - q > 0 AND 1 - 2 * q > 0 THEN -0.5 * ln(1 - 2 * p - q) - 0.25 * ln(1 - 2 * q) END AS k2p FROM e)"""
_SETS = f"""r AS (SELECT DISTINCT {_SPECIMEN} AS id FROM bcdm_records WHERE {_SPECIMEN} IS NOT NULL),
      b AS (SELECT DISTINCT upper({sql_clean("ids")}) AS id FROM embedding_bundle WHERE {sql_clean("ids")} IS NOT NULL)"""

SQL = {
    "null_clean": " UNION ALL ".join(
        f"SELECT '{r}' AS rank, count(*) - count({sql_clean(r)}) AS n_missing, count(DISTINCT {sql_clean(r)}) AS n_spellings FROM bcdm_records" for r in RANKS
    ),
    "marker_rank_filter": f"""SELECT {sql_taxon("tax_order")} AS tax_order, count(*) AS n_rows FROM bcdm_records
        WHERE marker_code = 'COI-5P' AND lower({_COLLAPSED.replace("{0}", "phylum")}) = 'basyptata' GROUP BY 1""",
    "drop_reason_accounting": f"WITH {_sql_selection()} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n_rows FROM a GROUP BY 1",
    "selection_counters": f"""WITH {_sql_selection()} SELECT count(*) AS n_rows, count(DISTINCT {sql_bin("bin_uri")}) AS n_bins, count({sql_clean("tax_class")}) AS n_children FROM g""",
    "child_rank_counts": f"""WITH {_sql_selection()} SELECT {sql_clean("tax_class")} AS child, count(*) AS n_rows FROM g GROUP BY 1
        HAVING child IS NOT NULL ORDER BY n_rows DESC, child LIMIT 10""",
    "window_assess": f"WITH {_sql_window()} SELECT * EXCLUDE (bin_uri, s) FROM m",
    "window_assess_fuzzy": f"WITH {_sql_window(FUZZY_PRIMERS, find=_sql_fuzzy)} SELECT * EXCLUDE (bin_uri, s) FROM m",
    "primer_set_support": " UNION ALL ".join(
        f"""SELECT * FROM (WITH {_sql_window(p, find=_sql_fuzzy)} SELECT '{n}' AS primer_set, primer_support, coverage_rank, primer_mismatches, count(*) AS n_rows
            FROM m GROUP BY ALL)""" for n, p in seq.PRIMER_SETS.items()
    ),
    "bin_representatives": f"WITH {_sql_selection()} SELECT * FROM best",
    "representative_rows": f"""WITH {_sql_selection()} SELECT b.* EXCLUDE (ingested_at) REPLACE (output_sequence AS nuc), '{SHORT_PRIMERS.name}' AS selected_primer_set,
        primer_support AS selected_primer_support, primer_mismatches AS selected_primer_mismatches, window_start AS selected_window_start,
        window_end AS selected_window_end, window_length AS selected_window_length, ambiguity_count AS selected_ambiguities
        FROM bcdm_records b JOIN best ON b.record_no = best.record_no""",
    "window_summary": f"""WITH {_sql_selection()} SELECT primer_support, count(*) AS n_bins, min(window_length) AS shortest, max(window_length) AS longest,
        round(avg(window_length), 6) AS mean_length, round(avg(ambiguity_fraction), 6) AS mean_ambiguity FROM best GROUP BY 1""",
    "best_sequence_per_specimen": f"""SELECT specimen, record_no, acgt FROM (SELECT *, row_number() OVER (PARTITION BY specimen ORDER BY acgt DESC, record_no) AS k
        FROM (SELECT {_SPECIMEN} AS specimen, record_no, length(regexp_replace({_SEQ}, '[^ACGT]', '', 'g')) AS acgt FROM bcdm_records)
        WHERE specimen IS NOT NULL AND acgt IS NOT NULL) WHERE k = 1""",
    "revcomp_ambiguity": f"""SELECT record_no, reverse(translate({_SEQ}, '{seq.CODES}', '{seq.COMPLEMENTS}')) AS revcomp,
        length(regexp_replace({_SEQ}, '[ACGT]', '', 'g')) AS n_ambiguous FROM bcdm_records""",
    "seq_distance": f"""WITH {_SITES} SELECT bin_uri, count(*) AS n_pairs, sum(sites)::BIGINT AS sites, round(avg(p), 6) AS mean_p, round(avg(jc69), 6) AS mean_jc69,
        round(avg(k2p), 6) AS mean_k2p, round(max(k2p), 6) AS most_k2p FROM d GROUP BY bin_uri""",
    "lineage_counts": f"{_REC} SELECT array_to_string(chain, '|') AS path, n AS n_records FROM l",
    "subtree_rollup": f"{_REC} SELECT array_to_string(chain, '|') AS path, n AS n_records FROM sub",
    "distinct_taxa_by_prefix": f"{_REC} SELECT {_SPLIT.format('chain[-1]')} AS rank_no, count(*) AS n_taxa, sum(n)::BIGINT AS n_records FROM sub GROUP BY 1",
    "parent_votes": f"{_REC} SELECT {_PARENT_COLUMNS} FROM v",
    "canonical_parent": f"{_REC} SELECT {_PARENT_COLUMNS} FROM p",
    "dissolved_taxa": f"{_REC} SELECT array_to_string(chain, '|') AS path, n AS n_records FROM sub WHERE chain NOT IN (SELECT chain FROM g)",
    "reconciled_chain": f"{_REC} SELECT {_SPLIT.format('taxon')} AS rank_no, split_part(taxon, ':', 2) AS name, array_to_string(chain, '|') AS path FROM g",
    "lca_placement": f"{_REC} SELECT terminal AS bin_uri, array_to_string(attachment, '|') AS path, n_candidates, lifted, suspect FROM q",
    "plurality_placement": f"""{_REC} SELECT terminal AS bin_uri, array_to_string(chain, '|') AS path, n_candidates, false AS lifted, false AS suspect
        FROM (SELECT *, row_number() OVER (PARTITION BY terminal ORDER BY votes DESC, {_WORD.format("chain[-1]")}, split_part(chain[-1], ':', 2)) AS r FROM k) WHERE r = 1""",
    "lift_summary": f"""{_REC} SELECT coalesce({_SPLIT.format("attachment[-1]")}, -1) AS rank_no, count(*) AS n_placed, count(*) FILTER (lifted) AS n_lifted,
        count(*) FILTER (suspect) AS n_suspect FROM q GROUP BY 1""",
    "sidecar_rows": f"{_REC} SELECT * FROM ({_sql_sidecar('colon')})",
    "placement_annotation": f"""{_REC} SELECT terminal, '&rank=BIN,records=' || records || ',n_lineages=' || n_lineages || ',taxa=' || {_BRACES.format("lineages")} || ',counts=' || {_BRACES.format("counts")}
        || ',placed_at=' || placed_at || (CASE WHEN lifted = 'yes' THEN ',lifted=yes' ELSE '' END) || (CASE WHEN suspect = 'yes' THEN ',suspect=yes' ELSE '' END) AS annotation
        FROM ({_sql_sidecar('gtdb')})""",
    "sidecar_summary": f"""{_REC}, sc AS (SELECT *, split_part(placed_at, ':', 1) AS word, records - list_max(string_split(counts, '|')::BIGINT[]) AS minority FROM ({_sql_sidecar('colon')}))
        SELECT 'terminals' AS measure, 'all' AS bucket, count(*) AS n FROM sc UNION ALL SELECT 'lifted', 'all', count(*) FROM sc WHERE lifted = 'yes'
        UNION ALL SELECT 'suspect', 'all', count(*) FROM sc WHERE suspect = 'yes' UNION ALL SELECT 'placed', word, count(*) FROM sc GROUP BY word
        UNION ALL SELECT 'lifted_to', word, count(*) FROM sc WHERE lifted = 'yes' GROUP BY word
        UNION ALL SELECT 'minority', least(minority, 10)::VARCHAR, count(*) FROM sc WHERE lifted = 'yes' GROUP BY 2
        UNION ALL SELECT 'stay_records', x::VARCHAR, count(*) FROM sc, (VALUES (1), (2), (5)) t(x) WHERE lifted = 'yes' AND minority <= x GROUP BY x
        UNION ALL SELECT 'stay_percent', x::VARCHAR, count(*) FROM sc, (VALUES (1), (5), (10)) t(x) WHERE lifted = 'yes' AND minority / records <= x / 100 GROUP BY x
        UNION ALL SELECT 'dissolved', split_part(label, ':', 1), count(*) FROM (SELECT DISTINCT unnest(string_split(lineages, '|')) AS label FROM sc)
          WHERE label NOT IN (SELECT placed_at FROM sc) GROUP BY 2""",
    "top_suspects": f"""{_REC} SELECT terminal, n_lineages, placed_at FROM ({_sql_sidecar('colon')}) WHERE suspect = 'yes' ORDER BY n_lineages DESC, terminal DESC LIMIT 10""",
    "grafted_lineages": f"""{_REC} SELECT array_to_string(attachment[1:i], '|') AS path, count(*) AS n_terminals
        FROM (SELECT *, unnest(range(1, len(attachment) + 1)) AS i FROM q) GROUP BY 1""",
    "top_families": f"""WITH c AS (SELECT {sql_taxon("family")} AS f, count(*) AS n FROM bcdm_records GROUP BY 1),
        t AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) AS k FROM c WHERE f IS NOT NULL)
        SELECT CASE WHEN k <= 20 THEN f ELSE 'Other' END AS family, sum(n)::BIGINT AS n_rows FROM t GROUP BY 1""",
    "align_coverage": f"""WITH {_SETS} SELECT CASE WHEN r.id IS NULL THEN 'missing_from_records' WHEN b.id IS NULL THEN 'missing_from_bundle' ELSE 'shared' END AS coverage,
        count(*) AS n_ids FROM r FULL JOIN b ON r.id = b.id GROUP BY 1""",
    "shared_specimens": f"WITH {_SETS} SELECT id FROM r INTERSECT SELECT id FROM b",
    "bundle_only": f"WITH {_SETS} SELECT id FROM b EXCEPT SELECT id FROM r",
    "label_map_coalesce": f"""WITH r AS (SELECT {sql_taxon("family")} AS label, {sql_taxon("tax_order")} AS o FROM bcdm_records),
        m AS (SELECT label, o FROM (SELECT label, o, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, o) AS k FROM r
          WHERE label IS NOT NULL AND o IS NOT NULL GROUP BY label, o) WHERE k = 1)
        SELECT DISTINCT r.label, coalesce(m.o, r.label) AS taxon FROM r LEFT JOIN m ON r.label = m.label WHERE r.label IS NOT NULL""",
    "duplicate_specimens": f"SELECT {_SPECIMEN} AS id, count(*) AS n_rows FROM bcdm_records GROUP BY 1 HAVING id IS NOT NULL AND count(*) > 1",
    "species_key": f"WITH {_KEYED} SELECT species, species_key, n_rows FROM k",
    "species_shard": f"""WITH {_KEYED} SELECT (concat('0x', substr(sha256(species_key), 1, 16))::UBIGINT % {SHARDS})::INT AS shard, count(*) AS n_species,
        sum(n_rows)::BIGINT AS n_rows FROM k GROUP BY 1""",
    "header_parse": f"SELECT record_no, {sql_taxon('tax_class')} AS tax_class, {sql_taxon('family')} AS family FROM bcdm_records",
    "genus_family_map": f"""SELECT {sql_taxon("genus")} AS genus, count(DISTINCT {sql_taxon("family")}) AS n_families, min({sql_taxon("family")}) AS first_family
        FROM bcdm_records WHERE {sql_taxon("genus")} IS NOT NULL AND {sql_taxon("family")} IS NOT NULL GROUP BY 1""",
    "event_idempotent": """SELECT substr(sha256(concat_ws(chr(10), user_id::VARCHAR, event_type, props)), 1, 12) AS fingerprint,
        arg_min(event_id, ROW(ts, event_id)) AS event_id, count(*) AS n_delivered FROM events GROUP BY 1""",
    "release_bins": """SELECT release_tag, bin, min(n) AS least, max(n) AS most, count(*) AS n_rows FROM (SELECT release_tag, length(nuc) AS n,
        ntile(4) OVER (PARTITION BY release_tag ORDER BY length(nuc), record_no) AS bin FROM bcdm_records
        WHERE nuc IS NOT NULL AND release_tag IS NOT NULL) GROUP BY ALL""",
}
