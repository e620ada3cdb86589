"""A sample of ids that reruns, layouts and later arrivals don't change.

Every id has a persistent sequence number, kept in a stored registry to which
arrivals only add. Numbers form blocks of a fixed length, and a hash of the
block number alone decides which positions of the block are chosen, filled or
not, so later ids never move earlier choices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.text import blank_clean
from cladeflow.session import Scratch

BLOCK = 100
TAKE = 10
SEED = "cladeflow-1"
MOST_DELIVERIES = 3


def sample_id(cell: Column) -> Column:
    """The id without blanks around it and in capitals; null if missing."""
    return F.upper(blank_clean(cell))


def arrivals(rows: DataFrame, id_column: str = "ids", bundle: str = "bundle_no", order: str = "faiss_id") -> DataFrame:
    """(id, bundle, ord): the first arrival of each id. Missing ids are left out; a missing bundle or order comes after all."""
    return (
        rows.select(sample_id(F.col(id_column)).alias("id"), F.col(bundle).cast("bigint").alias("bundle"), F.col(order).cast("bigint").alias("ord"))
        .where("id IS NOT NULL")
        .groupBy("id")
        .agg(F.min(F.struct(F.col("bundle").isNull().alias("no_bundle"), "bundle", F.col("ord").isNull().alias("no_ord"), "ord")).alias("_first"))
        .select("id", "_first.bundle", "_first.ord")
    )


def _numbered(first: DataFrame, offset: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(id, seq_no) from ``offset`` in order of bundle, row and id, and the next free number.

    One range-partitioned sort orders the ids whatever their values look like;
    the driver adds up one count per partition.
    """
    keys = (F.col("bundle").isNull(), F.col("bundle"), F.col("ord").isNull(), F.col("ord"), F.col("id"))
    # Spark's row ids hold the partition above the lowest 33 bits and the position within it below.
    placed = scratch.keep(first.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftrightunsigned("_at", 33)
    begin = {}
    for p, n in sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        begin[p], offset = offset, offset + n
    start = F.element_at(F.create_map(*[F.lit(x) for pair in begin.items() for x in pair]), part) if begin else F.lit(0)
    return placed.select("id", (start + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("bigint").alias("seq_no")), offset


def number(first: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(id, seq_no) of ``arrivals`` rows; numbers in ``registry`` stay and new ids follow them."""
    scratch = Scratch(first.sparkSession, "numbers")
    if registry is None:
        return _numbered(first, 0, scratch)[0]
    last = registry.agg(F.max("seq_no")).first()[0]
    fresh = first.join(registry.select("id"), "id", "left_anti")
    return registry.select("id", "seq_no").unionByName(_numbered(fresh, 0 if last is None else last + 1, scratch)[0])


class Registry:
    """The stored table of (id, seq_no), one folder per delivery; numbers once given are only ever added to."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.parts, self.next = scratch, [], 0

    def table(self) -> DataFrame:
        return self.scratch.read("id string, seq_no bigint", *self.parts)

    def deliver(self, first: DataFrame) -> None:
        """Numbers the ids of ``arrivals`` rows that the registry doesn't know and stores them."""
        fresh = first.join(self.table().select("id"), "id", "left_anti") if self.parts else first
        given, self.next = _numbered(fresh, self.next, self.scratch)
        self.parts.append(self.scratch.write(given))


def delivered(rows: DataFrame, id_column: str = "ids", bundle: str = "bundle_no", order: str = "faiss_id", most: int = MOST_DELIVERIES) -> DataFrame:
    """(id, seq_no) of a registry to which the bundles came one after the other, rows without a bundle last.

    With more than ``most`` bundles, neighbouring ones come together; the numbers are the same.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "registry")
    first = scratch.keep(arrivals(rows, id_column, bundle, order))
    found = [r[0] for r in first.select("bundle").distinct().collect()]
    edges = sorted(b for b in found if b is not None)
    step = max(1, -(-len(edges) // most))
    registry = Registry(scratch)
    for i in range(0, len(edges), step):
        registry.deliver(first.where(F.col("bundle").between(edges[i], edges[min(i + step, len(edges)) - 1])))
    if None in found or not found:
        registry.deliver(first.where("bundle IS NULL"))
    return registry.table()


def block_sample(numbered: DataFrame, block: int = BLOCK, take: int = TAKE, seed: str = SEED) -> DataFrame:
    """(id, seq_no, block_no) of the chosen positions: ``take`` of every ``block``, the least by md5 of seed, block and position.

    Each position is chosen with probability take / block; an unfilled block
    has its choices fixed already. An empty table gives an empty sample.
    """
    ranked = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.lit(block - 1)),
            lambda p: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col("block_no").cast("string"), p.cast("string"))).alias("h"), p.alias("p")),
        )
    )
    chosen = (
        numbered.select(F.floor(F.col("seq_no") / block).alias("block_no"))
        .distinct()
        .select("block_no", F.explode(F.slice(ranked, 1, take)).alias("_c"))
        .select("block_no", (F.col("block_no") * block + F.col("_c.p")).alias("seq_no"))
    )
    return numbered.join(chosen, "seq_no").select("id", "seq_no", "block_no")
