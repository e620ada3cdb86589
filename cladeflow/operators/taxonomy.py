"""Lineages, counts, votes for parents, one canonical hierarchy, and the placement of terminals in it.

A taxon is text, ``<rank number>:<name>``, and a lineage its taxa from the top,
joined by SEPARATOR; so keys of joins and groups are plain strings. Chains are
attached to taxa at the end only. Cells are cleaned once, in ``observations``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.functions.text import taxon_name
from cladeflow.session import Scratch

# The ranks from the top, as columns, as words and as short prefixes; characters an annotation can't hold.
RANKS = ("kingdom", "phylum", "tax_class", "tax_order", "family", "subfamily", "tribe", "genus", "species", "subspecies")
RANK_WORDS = ("kingdom", "phylum", "class", "order", "family", "subfamily", "tribe", "genus", "species", "subspecies")
RANK_PREFIXES = ("k", "p", "c", "o", "f", "sf", "t", "g", "s", "ssp")
UNSAFE = "[](){},;=\t\r\n"
SEPARATOR = "\x1f"
SUSPECT_RANK = RANKS.index("family")


def rank_path(top: str, tip: str) -> tuple[str, ...]:
    """The rank columns below ``top`` down to ``tip``."""
    if top not in RANKS or tip not in RANKS or RANKS.index(tip) <= RANKS.index(top):
        raise ValueError(f"no ranks from {top} down to {tip}")
    return RANKS[RANKS.index(top) + 1 : RANKS.index(tip) + 1]


def lineage(ranks: Sequence[str] = RANKS) -> Column:
    """The filled ranks from the top as one text; empty without any."""
    names = [F.translate(taxon_name(F.col(r)), SEPARATOR, " ") for r in ranks]
    return F.concat_ws(SEPARATOR, *[F.concat(F.lit(f"{i}:"), n) for i, n in enumerate(names)])


def taxa(path: Column) -> Column:
    """The taxa of a lineage, from the top."""
    return F.split(path, SEPARATOR)


def path_text(path: Column) -> Column:
    """A lineage as text, its taxa joined by bars."""
    return F.translate(path, SEPARATOR, "|")


def rank_no(taxon: Column) -> Column:
    return F.substring_index(taxon, ":", 1).cast("int")


def name(taxon: Column) -> Column:
    return taxon.substr(F.instr(taxon, ":") + 1, F.length(taxon))


def describe(taxon: Column, style: str = "colon") -> Column:
    """A taxon as a label: ``genus:Abies``, or ``g__Abies`` with underscores for blanks in style ``gtdb``."""
    words = RANK_PREFIXES if style == "gtdb" else RANK_WORDS
    word = F.element_at(F.create_map(*[F.lit(x) for i, w in enumerate(words) for x in (i, w)]), rank_no(taxon))
    return F.concat(word, F.lit("__"), F.translate(name(taxon), " ", "_")) if style == "gtdb" else F.concat(word, F.lit(":"), name(taxon))


def observations(records: DataFrame, terminal: Column, ranks: Sequence[str] = RANKS) -> DataFrame:
    """(terminal, path, n_records): each distinct lineage of each terminal; the terminal may be null, the path empty."""
    return records.groupBy(terminal.alias("terminal"), lineage(ranks).alias("path")).agg(F.count(F.lit(1)).alias("n_records"))


def lineage_counts(records: DataFrame, ranks: Sequence[str] = RANKS) -> DataFrame:
    """(path, n_records) of each distinct lineage; records without any taxon have the empty path."""
    return records.groupBy(lineage(ranks).alias("path")).agg(F.count(F.lit(1)).alias("n_records"))


def subtree_counts(counts: DataFrame) -> DataFrame:
    """(path, n_records) of every prefix of every lineage: totals of subtrees."""
    ends = F.sequence(F.lit(1), F.size(taxa(F.col("path"))))
    prefixes = F.transform(ends, lambda i: F.call_function("substring_index", F.col("path"), F.lit(SEPARATOR), i))
    return counts.where("path != ''").select(F.explode(prefixes).alias("path"), "n_records").groupBy("path").agg(F.sum("n_records").alias("n_records"))


def parent_votes(counts: DataFrame) -> DataFrame:
    """(taxon, parent, votes): how many records put a taxon right below another; null for no parent."""
    steps = F.transform(taxa(F.col("path")), lambda t, i: F.struct(t.alias("taxon"), F.when(i > 0, F.get(taxa(F.col("path")), i - 1)).alias("parent")))
    return counts.where("path != ''").select(F.inline(steps), "n_records").groupBy("taxon", "parent").agg(F.sum("n_records").alias("votes"))


def canonical_parents(votes: DataFrame) -> DataFrame:
    """(taxon, parent, votes): the deepest-ranked parent, then the one with most votes, then the least name."""
    w = Window.partitionBy("taxon").orderBy(F.coalesce(rank_no(F.col("parent")), F.lit(-1)).desc(), F.desc("votes"), F.col("parent").asc_nulls_first())
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("taxon", "parent", "votes")


def reconciled_chains(parents: DataFrame) -> DataFrame:
    """(taxon, chain): the canonical lineage of each taxon, by doubling; a parent's rank is always higher, so there are no cycles."""
    scratch = Scratch(parents.sparkSession, "chains")
    state = scratch.keep(parents.select("taxon", F.col("parent").alias("ptr"), F.col("taxon").alias("chain")))
    for _ in range(len(RANKS)):
        ahead = state.select(F.col("taxon").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("chain").alias("up"))
        jumped = state.join(ahead, "ptr", "left").select("taxon", F.col("ptr2").alias("ptr"), F.concat_ws(SEPARATOR, "up", "chain").alias("chain"))
        old, state = state, scratch.keep(jumped)
        scratch.drop(old)
        if state.where("ptr IS NOT NULL").isEmpty():
            break
    return state.select("taxon", "chain")


def terminal_candidates(observed: DataFrame) -> DataFrame:
    """(terminal, taxon, votes): the lowest taxa that a terminal's records name."""
    low = F.substring_index("path", SEPARATOR, -1)
    return observed.where("terminal IS NOT NULL AND path != ''").groupBy("terminal", low.alias("taxon")).agg(F.sum("n_records").alias("votes"))


def resolve_candidates(candidates: DataFrame, chains: DataFrame) -> DataFrame:
    """(terminal, taxon, votes, n_candidates) without those above another candidate of the same terminal; a sole survivor takes all votes.

    Most terminals have one candidate and pass at once; of the others the
    ancestors are joined with the candidates by value, so that no terminal's
    candidates meet in all pairs.
    """
    scratch = Scratch(candidates.sparkSession, "candidates")
    candidates = scratch.keep(candidates)
    totals = candidates.groupBy("terminal").agg(F.count(F.lit(1)).alias("n"), F.sum("votes").alias("total"), F.max("taxon").alias("taxon"))
    single = totals.where("n = 1").select("terminal", "taxon", F.col("total").alias("votes"), F.lit(1).cast("bigint").alias("n_candidates"))
    many = candidates.join(totals.where("n > 1").select("terminal", "total"), "terminal")
    above = many.join(chains, "taxon").select("terminal", F.explode(F.slice(F.reverse(taxa(F.col("chain"))), 2, len(RANKS))).alias("taxon")).distinct()
    kept = scratch.keep(many.join(above, ["terminal", "taxon"], "left_anti"))
    left = kept.groupBy("terminal").agg(F.count(F.lit(1)).alias("n_candidates"))
    votes = F.when(F.col("n_candidates") == 1, F.col("total")).otherwise(F.col("votes"))
    return single.unionByName(kept.join(left, "terminal").select("terminal", "taxon", votes.alias("votes"), "n_candidates"))


def place_terminals(resolved: DataFrame, chains: DataFrame, policy: str = "lca", suspect_rank: int = SUSPECT_RANK) -> DataFrame:
    """(terminal, placed_at, attachment, n_candidates, lifted, suspect) by the last common ancestor or by plurality.

    An ancestor that all candidates of a terminal have is common; of those the
    lowest is the last. ``placed_at`` is null and ``attachment`` empty at the
    root. ``lifted`` means that candidates disagreed, ``suspect`` that the
    attachment's rank is ``suspect_rank`` or higher up (or there is none).
    """
    single = resolved.where("n_candidates = 1").select("terminal", F.col("taxon").alias("placed_at"), "n_candidates")
    many = resolved.where("n_candidates > 1")
    if policy == "plurality":
        best = many.groupBy("terminal", "n_candidates").agg(F.max("votes").alias("votes"))
        key = F.struct(F.substring_index(describe(F.col("taxon")), ":", 1), name(F.col("taxon")))
        won = many.join(best, ["terminal", "n_candidates", "votes"]).groupBy("terminal", "n_candidates").agg(F.min_by("taxon", key).alias("placed_at"))
    elif policy == "lca":
        above = many.join(chains, "taxon").select("terminal", "n_candidates", F.explode(taxa(F.col("chain"))).alias("taxon"))
        common = above.groupBy("terminal", "n_candidates", "taxon").agg(F.count(F.lit(1)).alias("n")).withColumn("common", F.when(F.col("n") == F.col("n_candidates"), F.col("taxon")))
        # Common ancestors are of different ranks, and a rank's number comes first.
        won = common.groupBy("terminal", "n_candidates").agg(F.max("common").alias("placed_at"))
    else:
        raise ValueError(f"no such policy: {policy}")
    lifted = (F.col("n_candidates") > 1) if policy == "lca" else F.lit(False)
    low = F.coalesce(rank_no(F.col("placed_at")), F.lit(-1)) <= suspect_rank
    placed = single.unionByName(won.select("terminal", "placed_at", "n_candidates"))
    return placed.join(chains.select(F.col("taxon").alias("placed_at"), F.col("chain").alias("attachment")), "placed_at", "left").select(
        "terminal", "placed_at", F.coalesce("attachment", F.lit("")).alias("attachment"), "n_candidates", lifted.alias("lifted"), (lifted & low).alias("suspect")
    )


def lift_summary(placed: DataFrame) -> DataFrame:
    """(rank_no, n_placed, n_lifted, n_suspect) by the rank of the attachment; -1 for the root."""
    return placed.groupBy(F.coalesce(rank_no(F.col("placed_at")), F.lit(-1)).alias("rank_no")).agg(
        F.count(F.lit(1)).alias("n_placed"), F.count_if("lifted").alias("n_lifted"), F.count_if("suspect").alias("n_suspect")
    )


def sidecar(candidates: DataFrame, placed: DataFrame, rank: str = "BIN", style: str = "colon") -> DataFrame:
    """(terminal, rank, placed_at, lifted, suspect, n_lineages, records, lineages, counts) as text cells of the sidecar table.

    ``lineages`` and ``counts`` list all candidates with most records first
    (ties: by rank word, then name), joined by bars. A terminal has at most as
    many as there are taxa its records name.
    """
    label = describe(F.col("taxon"), "colon")
    entry = F.struct((-F.col("votes")).alias("v"), F.substring_index(label, ":", 1).alias("word"), name(F.col("taxon")).alias("name"), describe(F.col("taxon"), style).alias("label"))
    listed = candidates.groupBy("terminal").agg(F.array_sort(F.collect_list(entry)).alias("e"), F.sum("votes").alias("records"))
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no").alias(c)
    return listed.join(placed, "terminal").select(
        "terminal", F.lit(rank).alias("rank"), F.coalesce(describe(F.col("placed_at"), style), F.lit("root")).alias("placed_at"), yes("lifted"), yes("suspect"),
        F.size("e").alias("n_lineages"), "records",
        F.array_join(F.transform("e", lambda x: x["label"]), "|").alias("lineages"),
        F.array_join(F.transform("e", lambda x: (-x["v"]).cast("string")), "|").alias("counts"),
    )


def safe(value: Column) -> Column:
    """Characters that a tree comment can't hold become underscores."""
    return F.translate(value, UNSAFE, "_" * len(UNSAFE))


def annotation(table: DataFrame) -> DataFrame:
    """(terminal, annotation): a sidecar row as the comment of a tree; lists of several stand in braces."""
    listed = lambda c: F.transform(F.split(c, r"\|"), safe)
    braces = lambda items: F.when(F.size(items) == 1, items[0]).otherwise(F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}")))
    field = lambda k, v: F.concat(F.lit(f"{k}="), v)
    parts = [
        field("rank", safe(F.col("rank"))),
        field("records", F.col("records").cast("string")),
        field("n_lineages", F.col("n_lineages").cast("string")),
        field("taxa", braces(listed("lineages"))),
        field("counts", braces(listed("counts"))),
        field("placed_at", safe(F.col("placed_at"))),
        F.when(F.col("lifted") == "yes", "lifted=yes"),
        F.when(F.col("suspect") == "yes", "suspect=yes"),
    ]
    return table.select("terminal", F.concat(F.lit("&"), F.concat_ws(",", *parts)).alias("annotation"))


def sidecar_summary(table: DataFrame, minorities: Sequence[int] = (1, 2, 5), shares: Sequence[float] = (0.01, 0.05, 0.10)) -> DataFrame:
    """(measure, bucket, n) of a sidecar table.

    ``terminals``, ``lifted``, ``suspect``; ``placed`` and ``lifted_to`` by rank
    word; ``minority`` by the records outside a lifted terminal's largest lineage
    (10 for more); ``stay_records`` and ``stay_percent``: lifts that wouldn't be
    if so small a minority didn't count; ``dissolved`` by rank word: taxa that
    are in a lineage but hold no terminal.
    """
    word = F.regexp_extract("placed_at", "^([^:_]*)", 1)
    counts = F.transform(F.split("counts", r"\|"), lambda c: c.cast("bigint"))
    rows = table.select("placed_at", word.alias("word"), "lifted", "suspect", "lineages", "records", (F.col("records") - F.array_max(counts)).alias("minority"))
    yes = F.col("lifted") == "yes"
    measure = lambda m, bucket, holds: F.struct(F.lit(m).alias("measure"), bucket.alias("bucket"), holds.alias("holds"))
    everything = F.lit("all")
    measures = [
        measure("terminals", everything, F.lit(True)),
        measure("lifted", everything, yes),
        measure("suspect", everything, F.col("suspect") == "yes"),
        measure("placed", F.col("word"), F.lit(True)),
        measure("lifted_to", F.col("word"), yes),
        measure("minority", F.least("minority", F.lit(10)).cast("string"), yes),
        *[measure("stay_records", F.lit(str(m)), yes & (F.col("minority") <= m)) for m in minorities],
        *[measure("stay_percent", F.lit(str(round(s * 100))), yes & (F.col("minority") / F.col("records") <= s)) for s in shares],
    ]
    counted = rows.select(F.inline(F.array(*measures))).where("holds").groupBy("measure", "bucket").agg(F.count(F.lit(1)).alias("n"))
    named = rows.select(F.explode(F.split("lineages", r"\|")).alias("label")).distinct()
    dissolved = named.join(rows.select(F.col("placed_at").alias("label")).distinct(), "label", "left_anti")
    by_word = dissolved.groupBy(F.regexp_extract("label", "^([^:_]*)", 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(by_word.select(F.lit("dissolved").alias("measure"), "bucket", "n"))
