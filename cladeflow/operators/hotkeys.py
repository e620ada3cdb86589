"""Per-key counts and exact quantiles in balanced time, whatever share of the rows a key holds.

Distributed exact selection: every pass counts rows in equal-width bins of the
value, per key. The counts merge map-side, so a hot key costs each task one
small table of bins and never gathers its values anywhere. The bin that holds a
wanted rank is split again until it is one value wide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.session import Scratch

BROADCAST_ROWS = 50_000
SALTS = 16


def unpivot_keys(rows: DataFrame, keys: dict[str, Column], value: Column | None = None) -> DataFrame:
    """One row (field_name, key_text, value) per row and non-null key."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field_name"), k.alias("key_text")) for n, k in keys.items()])
    value = F.lit(None).cast("bigint") if value is None else value.cast("bigint")
    return (
        rows.select(value.alias("value"), F.explode(pairs).alias("_k"))
        .select("_k.field_name", "_k.key_text", "value")
        .where(F.col("key_text").isNotNull())
    )


def _cumulated(hist: DataFrame) -> DataFrame:
    """Adds the count of lower bins of the same target; at most ``bins`` rows meet per target."""
    w = Window.partitionBy("field_name", "key_text", "base").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))


def key_quantiles(
    rows: DataFrame,
    keys: dict[str, Column],
    value: Column,
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    bins: int = 1024,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Per key: ``n_rows``, ``n_values`` and the exact lower quantiles ``q<percent>`` of an integer value.

    A quantile p is the value of rank ``ceil(p * n_values)``, 1 at least. Null
    keys are no keys; null values count in ``n_rows`` only, and a key without
    values has null quantiles. An empty table gives an empty result. Columns of
    ``rows`` other than those named in the expressions don't matter.

    The table of still open bins has a row per key and open rank. It is
    broadcast only while it has at most ``broadcast_rows`` rows; beyond that the
    rows are counted by value first and joined by shuffle salted by the value, so
    that neither a hot key nor a hot value of it stays in one task.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "key-quantiles")
    long = unpivot_keys(rows, keys, value)
    names = [f"q{round(p * 100):02d}" for p in probs]
    whole = value.cast("bigint")
    lowest, highest = rows.agg(F.min(whole), F.max(whole)).first()
    lowest, highest = (0, 0) if lowest is None else (lowest, highest)
    width = max(1, -(-(highest - lowest + 1) // bins))

    # First pass: all rows of all keys, nulls in a bin of their own.
    lo = F.col("value") - (F.col("value") - F.lit(lowest)) % F.lit(width)
    hist = long.groupBy("field_name", "key_text", lo.cast("bigint").alias("lo")).agg(F.count(F.lit(1)).alias("n"))
    hist = scratch.keep(hist)
    totals = hist.groupBy("field_name", "key_text").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("lo").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"),
    )
    w_all = Window.partitionBy("field_name", "key_text")
    ranks = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    located = (
        _cumulated(hist.where("lo IS NOT NULL").withColumn("base", F.lit(0)))
        .withColumn("n_values", F.sum("n").over(w_all))
        .withColumn("r", F.explode(ranks))
        .withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("r.p") * F.col("n_values"))).cast("bigint"))
        .where("rank > below AND rank <= below + n")
        .select("field_name", "key_text", F.col("r.slot").alias("slot"), "lo", (F.col("rank") - F.col("below")).alias("rank"))
    )
    targets = scratch.keep(located)
    passes = 0
    while width > 1:
        finer = max(1, -(-width // bins))
        open_bins = targets.select("field_name", "key_text", F.col("lo").alias("base")).distinct()
        n_open = open_bins.count()
        inside = (F.col("value") >= F.col("base")) & (F.col("value") < F.col("base") + F.lit(width))
        if n_open <= broadcast_rows:
            hit = long.withColumn("c", F.lit(1)).join(F.broadcast(open_bins), ["field_name", "key_text"]).where(inside)
        else:
            salted = open_bins.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            counted_once = long.groupBy("field_name", "key_text", "value").agg(F.count(F.lit(1)).alias("c"))
            hit = (
                counted_once.withColumn("salt", F.pmod(F.hash("value"), F.lit(SALTS)))
                .join(salted, ["field_name", "key_text", "salt"])
                .where(inside)
            )
        lo = F.col("value") - (F.col("value") - F.col("base")) % F.lit(finer)
        counted = hit.groupBy("field_name", "key_text", "base", lo.cast("bigint").alias("lo")).agg(F.sum("c").alias("n"))
        wanted = targets.select("field_name", "key_text", "slot", F.col("lo").alias("base"), "rank")
        located = (
            _cumulated(counted)
            .join(wanted, ["field_name", "key_text", "base"])
            .where("rank > below AND rank <= below + n")
            .select("field_name", "key_text", "slot", "lo", (F.col("rank") - F.col("below")).alias("rank"))
        )
        finished, targets = targets, scratch.keep(located)
        scratch.drop(finished)
        width, passes = finer, passes + 1
    wide = targets.groupBy("field_name", "key_text").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("lo"))).alias(name) for i, name in enumerate(names)]
    )
    return totals.join(wide, ["field_name", "key_text"], "left")


def heavy_keys(profile: DataFrame, n_rows: int, share: float) -> DataFrame:
    """Keys of a profile with at least ``share`` of ``n_rows``; at most ``1 / share`` per field."""
    return profile.where(F.col("n_rows") >= F.lit(share) * F.lit(n_rows))
