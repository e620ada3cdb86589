"""One surviving record per group of duplicates, field by field.

Fields are unpivoted to long rows, every row votes for its normalised value
with source trust times recency decay, votes are summed per value, ``max_by``
picks each field's winner, and a pivot puts the fields side by side again.
Votes are whole numbers (trust times a power of two), so sums don't depend on
the order of rows. All groupings combine map-side: a group that holds a third
of the rows sends one partial row per value and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.text import bin_name, taxon_name

METRICS = {"coverage_rank": (0.0, 3.0), "primer_mismatches": (0.0, 10.0), "ambiguity_fraction": (0.0, 1.0)}
RANKS = ("kingdom", "phylum", "tax_class", "tax_order", "family", "subfamily", "tribe", "genus", "species")
AS_OF = "2026-01-01 00:00:00"
HALF_LIFE_DAYS = 180
HALVINGS = 20


def decayed(trust: Column, at: Column, as_of: str = AS_OF, half_life_days: int = HALF_LIFE_DAYS) -> Column:
    """trust * 2^(HALVINGS - whole half-lives of age); rows without a time are as old as can be."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(at)
    halvings = F.floor(F.greatest(age, F.lit(0)) / F.lit(half_life_days * 86400))
    left = F.lit(HALVINGS) - F.least(F.coalesce(halvings, F.lit(HALVINGS)), F.lit(HALVINGS))
    return trust.cast("bigint") * F.pow(F.lit(2.0), left).cast("bigint")


def elect(long: DataFrame, by: Sequence[str], fields: Sequence[str], newest_first: bool) -> DataFrame:
    """One row per ``by`` with the winning value of each field; null where nothing was voted for.

    ``long`` has ``by``, field, value, vote, at. With ``newest_first`` the value
    seen last wins and votes break ties of time; else votes win and time breaks
    ties. What is still tied goes to the least value.
    """
    sums = long.groupBy(*by, "field", "value").agg(F.sum("vote").alias("votes"), F.max("at").alias("newest"))
    order = ["newest", "votes"] if newest_first else ["votes", "newest"]
    ranked = sums.groupBy(*by, "field", *order).agg(F.min("value").alias("value"))
    return ranked.groupBy(*by).pivot("field", list(fields)).agg(F.max_by("value", F.struct(*order)))


def record_metrics(scorings: DataFrame) -> DataFrame:
    """(record_no, coverage_rank, primer_mismatches, ambiguity_fraction), each of the newest scoring where it is good.

    Null, NaN and out-of-range values don't vote; repeated scorings change
    nothing. Rows without record_no are dropped.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
            for f, (lo, hi) in METRICS.items()
        ]
    )
    trust = F.when(F.col("primer_support") == "both", 4).when(F.col("primer_support").like("%only"), 2).otherwise(1)
    long = (
        scorings.where("record_no IS NOT NULL")
        .select("record_no", F.col("scored_at").alias("at"), decayed(trust, F.col("scored_at")).alias("vote"), F.explode(pairs).alias("_p"))
        .select("record_no", "at", "vote", "_p.field", "_p.value", "_p.lo", "_p.hi")
        .where("value IS NOT NULL AND NOT isnan(value) AND value BETWEEN lo AND hi")
        .drop("lo", "hi")
    )
    return elect(long, ["record_no"], list(METRICS), newest_first=True)


def _scored(records: DataFrame, scorings: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    named = records.select(bin_name(F.col("bin_uri")).alias("bin_uri"), "record_no", *extra).where("bin_uri IS NOT NULL")
    return named.join(record_metrics(scorings), "record_no", "left")


def _best(scored: DataFrame) -> DataFrame:
    parts = [p for f in METRICS for p in (F.col(f).isNull(), F.col(f))]
    return (
        scored.groupBy("bin_uri")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min_by(F.struct("record_no", *METRICS), F.struct(*parts, "record_no")).alias("best"))
        .where("n_rows >= 2")
    )


def best_records(records: DataFrame, scorings: DataFrame) -> DataFrame:
    """(bin_uri, record_no) of the survivor of every BIN that at least two rows name.

    The least (coverage_rank, primer_mismatches, ambiguity_fraction, record_no)
    survives; a missing value comes after all values. Rows whose cell names no
    BIN are in no group. Empty tables give an empty result; without scorings
    the least record_no survives.
    """
    return _best(_scored(records, scorings)).select("bin_uri", "best.record_no")


def survivors(records: DataFrame, scorings: DataFrame) -> DataFrame:
    """The survivor of each BIN with the taxon of every rank elected by all rows of the BIN.

    A row's trust is 8 for coverage rank 0, 4 for 1, 2 for 2 and 1 beyond;
    its age is that of ``ingested_at``. Missing cells don't vote, spellings that
    differ in blanks and letter case vote together.
    """
    scored = _scored(records, scorings, [*RANKS, "ingested_at"])
    best = _best(scored).select("bin_uri", "n_rows", "best.*")
    trust = F.when(F.col("coverage_rank") == 0, 8).when(F.col("coverage_rank") == 1, 4).when(F.col("coverage_rank") == 2, 2).otherwise(1)
    cells = F.array(*[F.struct(F.lit(r).alias("field"), taxon_name(F.col(r)).alias("value")) for r in RANKS])
    long = (
        scored.select("bin_uri", F.col("ingested_at").alias("at"), decayed(trust, F.col("ingested_at")).alias("vote"), F.explode(cells).alias("_c"))
        .select("bin_uri", "at", "vote", "_c.field", "_c.value")
        .where("value IS NOT NULL")
    )
    return best.join(elect(long, ["bin_uri"], RANKS, newest_first=False), "bin_uri", "left")
