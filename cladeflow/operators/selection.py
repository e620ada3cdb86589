"""Scored records: the gates they pass or fail at, and the best one per group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.functions import seq
from cladeflow.functions.text import bin_name, blank_clean
from cladeflow.operators.taxonomy import RANK_WORDS, RANKS

# The reasons to drop a record, in the order they are asked.
REASONS = ("missing_bin", "missing_sequence", "empty_after_clean", "below_min_sequence_length", "too_ambiguous", "empty_after_crop")


@dataclass(frozen=True)
class Gates:
    """What a selection asks of a record. ``shortest`` 0 asks for no length; without ``marker`` any will do."""

    rank: str
    taxon: str
    marker: str | None = None
    shortest: int = 0
    most_ambiguous: float = 1.0
    crop: tuple[int, int] | None = None


def parse_taxon(spec: str) -> tuple[str, str]:
    """(rank column, name in small letters) of ``rank:name``."""
    rank, colon, name = (part.strip() for part in spec.partition(":"))
    if not colon or rank.lower() not in RANK_WORDS or not name:
        raise ValueError(f"not a rank and a name: {spec}")
    return RANKS[RANK_WORDS.index(rank.lower())], name.lower()


def parse_crop(spec: str) -> tuple[int, int]:
    """(start, end) of ``start:end``, from 0, end exclusive."""
    start, colon, end = spec.partition(":")
    if not colon or not 0 <= int(start) < int(end):
        raise ValueError(f"not a window: {spec}")
    return int(start), int(end)


def child_rank(rank: str) -> str | None:
    """The next rank below, none below the last."""
    return dict(zip(RANKS, RANKS[1:])).get(rank)


def in_scope(records: DataFrame, gates: Gates) -> DataFrame:
    """Records of the taxon, in any letter case, and of the marker as written."""
    rows = records.where(F.lower(blank_clean(F.col(gates.rank))) == gates.taxon)
    return rows if gates.marker is None else rows.where(blank_clean(F.col("marker_code")) == gates.marker)


def assessed(records: DataFrame, gates: Gates, primers: seq.Primers, mismatches: int = 0) -> DataFrame:
    """(record_no, bin_uri, metrics, output_sequence, drop_reason) of the records in scope.

    ``metrics`` are of the window between the primers, ``output_sequence`` is
    that window after the crop. ``drop_reason`` is the first of REASONS that
    holds, null for a sound record; ambiguity is that of the window.
    """
    raw = blank_clean(F.col("nuc"))
    cleaned = in_scope(records, gates).select(
        "record_no", bin_name(F.col("bin_uri")).alias("bin_uri"), raw.isNull().alias("_none"), F.nullif(seq.clean_sequence(raw), F.lit("")).alias("_seq")
    )
    m = F.col("metrics")
    windowed = seq.assess_window(cleaned, "_seq", primers, mismatches).withColumn(
        "_out", F.col("_seq").substr(m["window_start"] + 1, m["window_length"])
    )
    out = seq.crop(F.col("_out"), *gates.crop) if gates.crop else F.col("_out")
    tests = (
        F.col("bin_uri").isNull(),
        F.col("_none"),
        F.col("_seq").isNull(),
        F.length("_seq") < gates.shortest,
        m["ambiguity_fraction"] > gates.most_ambiguous,
        F.length(out) == 0,
    )
    reason = F.coalesce(*[F.when(t, r) for t, r in zip(tests, REASONS)])
    return windowed.select("record_no", "bin_uri", "metrics", out.alias("output_sequence"), reason.alias("drop_reason"))


def score_records(records: DataFrame, primers: seq.Primers, mismatches: int = 0) -> DataFrame:
    """(record_no, bin_uri, metrics): each record's window between the primers, scored."""
    cleaned = records.select("record_no", bin_name(F.col("bin_uri")).alias("bin_uri"), seq.clean_sequence(F.col("nuc")).alias("_seq"))
    return seq.assess_window(cleaned, "_seq", primers, mismatches).drop("_seq")


def best_per_group(scored: DataFrame, group: str = "bin_uri", ordinal: str = "record_no", carry: tuple[str, ...] = ()) -> DataFrame:
    """The best record of each group by six keys, the first row winning ties; groups and sequences must not be null."""
    m = F.col("metrics")
    keys = F.struct(
        m["coverage_rank"],
        m["primer_mismatches"],
        m["tiebreak_length"],
        m["ambiguity_fraction"],
        m["ambiguity_count"],
        -m["window_length"],
        F.col(ordinal),
    )
    return (
        scored.where(F.col(group).isNotNull() & F.col("metrics").isNotNull())
        .groupBy(group)
        .agg(F.min_by(F.struct(ordinal, "metrics.*", *carry), keys).alias("best"))
        .select(group, "best.*")
    )


def representatives(records: DataFrame, gates: Gates, primers: seq.Primers, mismatches: int = 0) -> DataFrame:
    """(bin_uri, record_no, …, output_sequence): the best record of each BIN among those that pass all gates."""
    return best_per_group(assessed(records, gates, primers, mismatches).where("drop_reason IS NULL"), carry=("output_sequence",))


def representative_rows(records: DataFrame, chosen: DataFrame, primers: seq.Primers, sequence: str = "nuc") -> DataFrame:
    """The chosen records as they came, the sequence cut to its window, with seven derived columns, in order of the BIN."""
    derived = {
        "primer_set": F.lit(primers.name),
        "primer_support": F.col("primer_support"),
        "primer_mismatches": F.col("primer_mismatches"),
        "window_start": F.col("window_start"),
        "window_end": F.col("window_end"),
        "window_length": F.col("window_length"),
        "ambiguities": F.col("ambiguity_count"),
    }
    own = chosen.select("record_no", F.col("bin_uri").alias("_bin"), F.col("output_sequence").alias("_out"), *[c.alias(f"selected_{n}") for n, c in derived.items()])
    joined = records.join(own, "record_no").withColumn(sequence, F.col("_out"))
    return joined.orderBy("_bin").select(*records.columns, *[f"selected_{n}" for n in derived])
