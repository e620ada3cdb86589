"""Pairs of rows: within groups, seeded samples, and samples by level; no group's pairs are formed in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.session import Scratch

SALTS = 16


def within_groups(rows: DataFrame, group: str, key: str, every: int, salts: int = SALTS) -> DataFrame:
    """Each row whose key is divisible by ``every`` with every other row of its group, each pair once; the other's columns end in ``_2``.

    The asking rows are copied to all salts and the others spread over them by a
    hash of the key, so that a hot group's pairs are made in ``salts`` tasks at
    least. Rows without group or key pair with none.
    """
    sound = rows.where(F.col(group).isNotNull() & F.col(key).isNotNull())
    asked = sound.where(F.col(key) % every == 0).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    others = sound.select(group, *[F.col(c).alias(f"{c}_2") for c in sound.columns if c != group]).withColumn("_salt", F.pmod(F.xxhash64(f"{key}_2"), F.lit(salts)).cast("int"))
    a, b = F.col(key), F.col(f"{key}_2")
    return asked.join(others, [group, "_salt"]).where((b > a) | ((b < a) & (b % every != 0))).drop("_salt")


def all_within_groups(rows: DataFrame, group: str, key: str, most_pairs: int) -> DataFrame:
    """All pairs of distinct rows of each group, lower key first; more than ``most_pairs`` in all are refused before any is formed."""
    sound = rows.where(F.col(group).isNotNull() & F.col(key).isNotNull())
    sizes = sound.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint")).first()[0] or 0
    if total > most_pairs:
        raise ValueError(f"{total} pairs, more than {most_pairs}")
    salted = sound.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    others = sound.select(group, *[F.col(c).alias(f"{c}_2") for c in sound.columns if c != group]).withColumn("_salt", F.pmod(F.xxhash64(f"{key}_2"), F.lit(SALTS)).cast("int"))
    return salted.join(others, [group, "_salt"]).where(F.col(key) < F.col(f"{key}_2")).drop("_salt")


def ordinals(rows: DataFrame, key: str, scratch: Scratch, name: str = "ordinal") -> tuple[DataFrame, int]:
    """The rows with their number from 0 in order of a unique key, and how many there are: one range-partitioned sort."""
    placed = scratch.keep(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    begin, total = {}, 0
    for p, n in sorted(tuple(r) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        begin[p], total = total, total + n
    start = F.element_at(F.create_map(*[F.lit(x) for pair in begin.items() for x in pair]), part) if begin else F.lit(0)
    return placed.withColumn(name, (start + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("bigint")).drop("_at"), total


def drawn(text: Column, total: int) -> Column:
    """A number from 0 to ``total`` - 1 that follows from a text: the first 15 hex digits of its md5."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), F.lit(total))


def sampled_numbers(spark, total: int, limit: int, seed: str) -> DataFrame:
    """(number): all numbers below ``total`` if there are at most ``limit``, else ``limit`` distinct ones drawn by hashes of seed and draw."""
    if total <= limit:
        return spark.range(total).withColumnRenamed("id", "number")
    draws = spark.range(2 * limit).select("id", drawn(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")), total).alias("number"))
    return draws.groupBy("number").agg(F.min("id").alias("draw")).orderBy("draw").limit(limit).select("number")


def sampled_pairs(rows: DataFrame, key: str, limit: int, seed: str = "pairs-1") -> DataFrame:
    """A seeded uniform sample of ``limit`` distinct pairs of rows (all if there are no more); the other's columns end in ``_2``.

    The same rows give the same pairs in every layout. Pair t of n * (n - 1) / 2
    is (i, j), i < j, with t = j * (j - 1) / 2 + i.
    """
    scratch = Scratch(rows.sparkSession, "pairs")
    numbered, n = ordinals(rows.where(F.col(key).isNotNull()), key, scratch)
    t = F.col("number")
    root = F.floor((1 + F.sqrt(1 + 8 * t.cast("double"))) / 2)
    j = F.when(root * (root - 1) / 2 > t, root - 1).when(root * (root + 1) / 2 <= t, root + 1).otherwise(root).cast("bigint")
    pairs = sampled_numbers(rows.sparkSession, n * (n - 1) // 2, limit, seed).select(t, j.alias("_j"))
    pairs = pairs.select((t - F.expr("_j * (_j - 1) div 2")).alias("ordinal"), F.col("_j").alias("ordinal_2"))
    other = numbered.select(*[F.col(c).alias(f"{c}_2") for c in numbered.columns])
    return pairs.join(numbered, "ordinal").join(other, "ordinal_2").drop("ordinal", "ordinal_2")


def partners(rows: DataFrame, group: str, key: str, seed: str = "partners-1") -> DataFrame:
    """Each row with one other row of its group, drawn by a hash of seed, group and key; the other's columns end in ``_2``.

    Rows of groups of one have no partner. As many pairs as rows, found by one
    join on the position within the group.
    """
    scratch = Scratch(rows.sparkSession, "partners")
    sound = rows.where(F.col(group).isNotNull() & F.col(key).isNotNull())
    placed, _ = ordinals(sound.withColumn("_k", F.struct(group, key)), "_k", scratch, "_o")
    begin = placed.groupBy(group).agg(F.min("_o").alias("_begin"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    text = F.concat_ws(":", F.lit(seed), F.col(group).cast("string"), F.col(key).cast("string"))
    step = F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), F.col("_n") - 1) + 1
    asking = placed.join(begin, group).withColumn("_at", F.col("_begin") + (F.col("_o") - F.col("_begin") + step) % F.col("_n")).drop("_k", "_o", "_begin", "_n")
    other = placed.select(F.col("_o").alias("_at"), *[F.col(c).alias(f"{c}_2") for c in sound.columns if c != group])
    return asking.join(other, "_at").drop("_at")


def sampled_rows(rows: DataFrame, key: str, limit: int, seed: str = "rows-1") -> DataFrame:
    """``limit`` rows with the least md5 of seed and key, so growing tables keep most of their sample."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(limit)


def by_level(pairs: DataFrame, level: str, limit: int, order: Column, salts: int = SALTS) -> DataFrame:
    """Up to ``limit`` pairs, spread evenly over levels: levels that run out hand their share to the others.

    With a quota q per level a level of size s gives min(s, q); q is the
    greatest for which all give at most ``limit`` together, and what is left
    goes to the lowest levels that have more. ``order`` must be the same for no
    two pairs of a level; the first by it are taken, per salt first.
    """
    sizes = sorted((r[0], r[1]) for r in pairs.groupBy(level).agg(F.count(F.lit(1)).alias("n")).collect())
    low, high = 0, max((n for _, n in sizes), default=0)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(min(n, middle) for _, n in sizes) <= limit else (low, middle - 1)
    spare = limit - sum(min(n, low) for _, n in sizes)
    quota = {}
    for name, n in sizes:
        quota[name] = min(n, low) + (1 if n > low and spare > 0 else 0)
        spare -= quota[name] > low
    if not quota:
        return pairs
    most = F.element_at(F.create_map(*[F.lit(x) for pair in quota.items() for x in pair]), F.col(level))
    first = Window.partitionBy(level, "_s").orderBy("_o")
    top = Window.partitionBy(level).orderBy("_o")
    ranked = pairs.withColumn("_o", order).withColumn("_s", F.pmod(F.xxhash64("_o"), F.lit(salts))).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most)
    return ranked.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= most).drop("_o", "_s", "_r")
