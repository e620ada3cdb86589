"""Groups of mutually similar vectors: a neighbour graph by descent, communities by modularity, then an exact check.

Rows alike within a block of arrivals contract to a super-node first, which is
a map-side combine: a huge group leaves one row per block. Super-nodes contract
again in cells around drawn ones, where those of a group meet. Neighbour lists start
from a few random-projection bucketings and descend: neighbours of a node are
compared with each other until lists hardly change. Links of the lists that
reach the threshold form the graph whose communities are merged as long as
modularity gains. All that only gathers what is surely linked. The exact check
finds every other link, between any two rows: each community's rows lie in balls
of known reach, balls are compared with balls by their centres, rows with the
centres that their own ball's reach leaves open, and only where the reach allows
a link the ball's rows are measured. Communities with a link are joined, so no
pair that reaches the threshold is apart.
Vectors travel as 16-bit floats (in lists as 8-bit numbers); what is near the
threshold is measured with the vectors as they are given.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from cladeflow.session import Scratch

DIMENSIONS = 64
THRESHOLD = 0.86
BLOCK = 4096
BUCKET = 1024
PIVOTS = 256
CELL_PASSES = 2
START_TABLES = 3
NEIGHBOURS = 5
CHANGED = 0.05
CHUNK = 64
MISS = 1e-6
RESOLUTION = 1.0
MARGIN = 0.002
CODE_MARGIN = 0.02
CODE_BOUND = 0.035  # what rounding both to 8-bit numbers changes a cosine near the threshold by, at most
LIST_BOUND = 0.032  # the same upwards: what a cosine of the lists is too large by, at most
HALF_ANGLE = 0.00055  # radians by which rounding to 16-bit floats turns a vector, at most
WIDE = math.radians(25)
SALTS = 16
SEED = 20240


def _matrix(column: pa.Array, kind=np.float16) -> np.ndarray:
    """Fixed-length binary cells as rows of a matrix."""
    if column.null_count or not len(column) or not pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, DIMENSIONS)
    _, offsets, data = column.buffers()
    start = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, kind, len(column) * DIMENSIONS, int(start)).reshape(-1, DIMENSIONS)


def _cells(matrix: np.ndarray, filled: np.ndarray | None = None) -> pa.Array:
    """Rows of a matrix as binary cells; null where not ``filled``."""
    if filled is not None:
        return pa.array([r.tobytes() if f else None for r, f in zip(matrix, filled)], pa.binary())
    matrix = np.ascontiguousarray(matrix)
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1] * matrix.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


def _leaders(unit: np.ndarray, threshold: float) -> np.ndarray:
    """Each row's leader: the first row not led yet leads all those alike that aren't either."""
    leader = np.full(len(unit), -1)
    for lo in range(0, len(unit), 256):
        still = np.flatnonzero(leader[lo:] < 0) + lo
        rows = still[: np.searchsorted(still, lo + 256)]
        tile = unit[rows] @ unit[still].T >= threshold
        for row, alike in zip(rows, tile):
            if leader[row] < 0:
                led = still[alike]
                leader[led[leader[led] < 0]] = row
                leader[row] = row
    return leader


def _raw_kind(rows: DataFrame, vector: str) -> type:
    """The numbers in which a column's vectors travel without loss."""
    return np.float32 if isinstance(rows.schema[vector].dataType.elementType, FloatType) else np.float64


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows, summed up in order of the dimensions as SQL does."""
    total, p, q = (np.zeros(len(x)) for _ in range(3))
    for a, b in zip(x.astype(np.float64).T, y.astype(np.float64).T):
        total += a * b
        p += a * a
        q += b * b
    return total / np.sqrt(p * q)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the usable rows: those with an id and DIMENSIONS finite numbers that aren't all zero."""
    for batch in batches:
        lists = batch.column(1)
        sound = np.asarray(batch.column(0).is_valid()) & np.asarray(lists.is_valid())
        length = np.where(sound, np.asarray(lists.value_lengths().fill_null(0)), 0)
        at = np.flatnonzero(length == DIMENSIONS)
        if not len(at):
            continue
        values = lists.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
        good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
        yield batch.column(0).take(pa.array(at[good])).to_numpy(zero_copy_only=False).astype(np.int64), values[good]


def contract_blocks(rows: DataFrame, key: str, vector: str, threshold: float, block: int) -> DataFrame:
    """(id, rep, vec, leads): usable rows with their super-node, vector, and whether they are one. A block costs the same whatever the table's size."""

    def solve(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        rep = _leaders(unit, threshold)
        own = rep == np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[rep]), _cells(unit.astype(np.float16)), pa.array(own)], names=["id", "rep", "vec", "leads"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for i, x in _usable(batches):
            ids.append(i)
            parts.append(x)
            held += len(i)
            while held >= block:
                i, x = np.concatenate(ids), np.concatenate(parts)
                yield solve(i[:block], x[:block])
                ids, parts, held = [i[block:]], [x[block:]], held - block
        if held:
            yield solve(np.concatenate(ids), np.concatenate(parts))

    return rows.select(F.col(key).cast("bigint").alias("id"), vector).mapInArrow(run, "id bigint, rep bigint, vec binary, leads boolean")


def contract_cells(nodes: DataFrame, threshold: float, seed: int, block: int = BLOCK, cell: int = BUCKET) -> DataFrame:
    """(id, rep, vec): nodes of (id, vec) with the node that leads them, from 16-bit vectors; only leaders keep ``vec``.

    A node goes to the cell of the pivot that it is most alike with, one of about
    n / ``cell`` drawn nodes (with more than PIVOTS, of several draws at once), so
    nodes of a group mostly meet, wherever they arrived. A cell is led in stretches
    of ``block`` nodes. Nodes that don't meet are left to the lists and the check.
    """
    n = nodes.count()
    wanted = max(1.0, n / cell)
    draws = max(1, math.ceil(math.log(wanted, PIVOTS)))
    each = math.ceil(wanted ** (1 / draws))
    # A share of about four times what is drawn goes to the driver, not every task's best.
    drawing = nodes.withColumn("_h", F.xxhash64(F.lit(seed), "id")).where(F.pmod("_h", F.lit(max(1, n // (4 * draws * each)))) == 0)
    drawn = drawing.orderBy("_h", "id").limit(draws * each).collect() if each > 1 else []
    pivots = np.array([np.frombuffer(r.vec, np.float16) for r in drawn], np.float32).reshape(-1, DIMENSIONS)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros(batch.num_rows, np.int64)
            if len(pivots) and len(code):
                x = _matrix(batch.column(1)).astype(np.float32)
                for d in range(0, len(pivots), each):
                    code = code * each + (x @ pivots[d : d + each].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(code), *batch.columns], names=["cell", "id", "vec"])

    def led(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = np.concatenate([p.column(1).to_numpy() for p in parts])
        half = np.concatenate([_matrix(p.column(2)) for p in parts])
        order = np.argsort(ids, kind="stable")
        ids, half = ids[order], half[order]
        rep = _leaders(_unit(half).astype(np.float32), threshold)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[rep]), _cells(half, rep == np.arange(len(ids)))], names=["id", "rep", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, None
        for batch in batches:
            code = batch.column(0).to_numpy()
            cuts = (np.flatnonzero(code[1:] != code[:-1]) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(code)]):
                while lo < hi:
                    if held and (at != code[lo] or size == block):
                        yield led(held)
                        held, size = [], 0
                    take = min(hi - lo, block - size)
                    at, size, lo = code[lo], size + take, lo + take
                    held.append(batch.slice(lo - take, take))
        if held:
            yield led(held)

    sent = nodes.select("id", "vec").mapInArrow(spread, "cell bigint, id bigint, vec binary")
    return sent.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "id bigint, rep bigint, vec binary")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links a-b that span every component of all of them, and each member's component."""
    label, at, picked = np.arange(n), np.arange(len(a)), []
    while True:
        la, lb = label[a[at]], label[b[at]]
        apart = la != lb
        if not apart.any():
            return np.concatenate(picked) if picked else at[:0], label
        at, la, lb = at[apart], la[apart], lb[apart]
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        order = np.lexsort((low, high))
        first = order[np.flatnonzero(np.concatenate([[True], high[order][1:] != high[order][:-1]]))]
        picked.append(at[first])
        to = np.arange(n)
        to[high[first]] = low[first]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _bucket_pairs(ids: np.ndarray, vectors: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, ...] | None:
    """(src, dst, similarity) that span what is surely linked, and all links near ``threshold`` between those parts.

    With rows of both sides only pairs across them are compared, else all pairs.
    """
    order = np.argsort(side, kind="stable")
    ids, x, low = ids[order], vectors[order].astype(np.float32), int((side == 0).sum())
    across = 0 < low < len(ids)
    near, sims = [], []
    for lo in range(0, low if across else len(ids), 1024):
        hi = min(lo + 1024, low) if across else lo + 1024
        off = low if across else lo
        tile = x[lo:hi] @ x[off:].T
        i, j = np.nonzero(tile >= threshold - MARGIN)
        keep = ids[i + lo] != ids[j + off] if across else i < j
        near.append(np.stack([i[keep] + lo, j[keep] + off]))
        sims.append(tile[i[keep], j[keep]])
    (a, b), w = np.concatenate(near, axis=1), np.concatenate(sims)
    if not len(a):
        return None
    sure = np.flatnonzero(w >= threshold + MARGIN)
    spanning, label = _forest(len(ids), a[sure], b[sure])
    take = np.concatenate([sure[spanning], np.flatnonzero((w < threshold + MARGIN) & (label[a] != label[b]))])
    take = take[ids[a[take]] != ids[b[take]]]
    return (ids[a[take]], ids[b[take]], w[take]) if len(take) else None


def _joined_groups(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links within every run of rows with the same group and part."""
    held = None
    for batch in batches:
        now = (*(batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)), _matrix(batch.column(4)))
        if held is not None:
            now = tuple(np.concatenate(c) for c in zip(held, now))
        group, part, side, ids, vectors = now
        cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(group)]
        out = [_bucket_pairs(ids[a:b], vectors[a:b], side[a:b], threshold) for a, b in zip(cuts[:-2], cuts[1:-1]) if b - a > 1]
        held = tuple(c[cuts[-2] :] for c in now)
        out = [o for o in out if o]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["src", "dst", "sim"])
    if held is not None and len(held[3]) > 1 and (o := _bucket_pairs(held[3], held[4], held[2], threshold)):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in o], names=["src", "dst", "sim"])


def bucketings(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) of least work with which a pair of at least ``threshold`` meets in no bucket with a chance of ``miss`` at most.

    Vectors at angle t agree in the sign of a random projection with chance
    1 - t / pi. A row costs its bucket's size, and about BUCKET for its way
    there, in each table; without bits one bucket holds all pairs.
    """
    agree = 1 - math.acos(max(-1.0, threshold - MARGIN)) / math.pi

    def tables(bits: int) -> int:
        return math.ceil(math.log(miss) / math.log1p(-(agree**bits))) if bits else 1

    bits = min(range(31), key=lambda b: tables(b) * (n / 2**b + BUCKET))
    return bits, tables(bits)


def projection_links(nodes: DataFrame, bits: int, tables: int, first: int, threshold: float, limit: int = 4 * BUCKET) -> DataFrame:
    """Links within buckets of random projections; ``tables`` bucketings by ``bits`` signs each.

    A bucket of more than ``limit`` rows is cut into parts by a hash of the id,
    and each part meets itself and every other part in a group of its own, so
    that all its pairs are compared and no task holds more than two parts.
    """

    def coded(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        vectors = _matrix(batch.column(1)).astype(np.float32)
        for t in range(tables):
            plane = np.random.default_rng(SEED + first + t).standard_normal((DIMENSIONS, bits)).astype(np.float32)
            yield (((vectors @ plane) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(vectors), np.int64)) * tables + t

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, n = np.unique(np.concatenate(list(coded(batch))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(n)], names=["group", "n"])

    sizes = nodes.select("id", "vec").mapInArrow(count, "group bigint, n bigint").groupBy("group").agg(F.sum("n").alias("n"))
    large = sorted(tuple(r) for r in sizes.where(F.col("n") > limit).collect())
    large_group = np.array([g for g, _ in large], np.int64)
    large_parts = np.array([-(-n // limit) for _, n in large], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for group in coded(batch):
                parts = np.ones(len(group), np.int64)
                if len(large_group):
                    at = np.minimum(np.searchsorted(large_group, group), len(large_group) - 1)
                    parts = np.where(large_group[at] == group, large_parts[at], 1)
                own = (mixed % parts.astype(np.uint64)).astype(np.int64)
                for other in range(int(parts.max(initial=0))):
                    rows = np.flatnonzero(other < parts)
                    mine = own[rows]
                    part = (np.minimum(mine, other) << 31) | np.maximum(mine, other)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group[rows]), pa.array(part), pa.array((mine > other).astype(np.int8)), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))],
                        names=["group", "part", "side", "id", "vec"],
                    )

    spread = nodes.select("id", "vec").mapInArrow(run, "group bigint, part bigint, side tinyint, id bigint, vec binary")
    ordered = spread.repartition("group", "part").sortWithinPartitions("group", "part")
    return ordered.mapInArrow(lambda it: _joined_groups(it, threshold), "src bigint, dst bigint, sim float")


def _runs(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole runs of equal first ``keys`` columns, cut into stretches of at most ``most`` rows; input is sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        columns = [table.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if table.num_rows > 1 else []
        starts = [0, *[int(x) for x in change]]
        for a, b in zip(starts[:-1], starts[1:]):
            for lo in range(a, b, most):
                yield table.slice(lo, min(most, b - lo))
        held = [table.slice(starts[-1])]
    if held:
        for lo in range(0, held[0].num_rows, most):
            yield held[0].slice(lo, most)


def _grouped_links(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """(src, dst, sim) batches of many small parts, each link once per batch."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > 50_000:
            yield _distinct_links(held)
            held, size = [], 0
    if held:
        yield _distinct_links(held)


def _distinct_links(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    src, dst, sim = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((dst, src))
    src, dst, sim = src[order], dst[order], sim[order]
    first = np.concatenate([[True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]) if len(src) else np.zeros(0, bool)
    return pa.RecordBatch.from_arrays([pa.array(src[first]), pa.array(dst[first]), pa.array(sim[first].astype(np.float32))], names=["src", "dst", "sim"])


def _best_of(ids: np.ndarray, sims: np.ndarray, k: int, least: float | np.ndarray) -> tuple[np.ndarray, ...]:
    """(src, dst, sim): each row's ``k`` most alike columns with a similarity above ``least``."""
    np.fill_diagonal(sims, -2)
    top = np.argpartition(-sims, min(k, len(ids) - 1) - 1, axis=1)[:, :k]
    best = np.take_along_axis(sims, top, axis=1)
    row, at = np.nonzero(best > (least if np.isscalar(least) else least[:, None]))
    return ids[row], ids[top[row, at]], best[row, at]


def starting_links(nodes: DataFrame, bits: int, tables: int, k: int, floor: float, piece: int = BUCKET) -> DataFrame:
    """(src, dst, sim): each node's ``k`` most alike within the pieces of its random-projection buckets; a first guess only."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1)).astype(np.float32)
            for t in range(tables):
                plane = np.random.default_rng(SEED + t).standard_normal((DIMENSIONS, bits)).astype(np.float32)
                code = (((vectors @ plane) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(vectors), np.int64)) * tables + t
                yield pa.RecordBatch.from_arrays([pa.array(code), batch.column(0), batch.column(1)], names=["bucket", "id", "vec"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for run in _runs(batches, 1, piece):
                if run.num_rows > 1:
                    ids, x = run.column(1).to_numpy(zero_copy_only=False), _matrix(run.column(2)).astype(np.float32)
                    yield _best_of(ids, x @ x.T, k, floor)

        return _grouped_links(parts())

    sent = nodes.select("id", "vec").mapInArrow(spread, "bucket bigint, id bigint, vec binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(best, "src bigint, dst bigint, sim float")


def _shortened(links: DataFrame, k: int) -> DataFrame:
    """(src, dst, sim, new): the ``k`` most alike of each node; ties are broken by a hash, so that no node is in all lists of its copies."""
    once = links.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    w = Window.partitionBy("src").orderBy(F.desc("sim"), F.xxhash64("src", "dst"))
    return once.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def neighbour_descent(nodes: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, k: int = NEIGHBOURS, changed: float = CHANGED, bucket: int = BUCKET) -> DataFrame:
    """(src, dst, sim): approximate lists of each node's ``k`` most alike, by neighbour descent.

    In each round the nodes that a node lists or is listed by are compared with
    each other, unless both were there before; who is more alike than the worst
    of a list takes its place. It ends once less than ``changed`` of all links
    are new. Similarities below cos(2 acos(threshold)) are left out: nodes both
    alike to a third are at least that alike, so such links lead nowhere. A node
    in very many lists is handled in chunks.
    """
    floor = max(-1.0, 2 * threshold * threshold - 1) - CODE_MARGIN
    n = nodes.count()
    bits = max(0, math.ceil(math.log2(max(1, n / bucket))))
    first = starting_links(nodes, bits, START_TABLES, k, floor, bucket).withColumn("new", F.lit(True))
    lists = scratch.keep(_shortened(first, k))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.rint(_matrix(batch.column(1)).astype(np.float32) * 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(0), _cells(code)], names=["id", "code"])

    codes = nodes.select("id", "vec").mapInArrow(coded, "id bigint, code binary")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for run in _runs(batches, 1, CHUNK):
                ids, first = np.unique(run.column(1).to_numpy(zero_copy_only=False), return_index=True)
                fresh = run.column(2).to_numpy(zero_copy_only=False)[first]
                if len(ids) > 1 and fresh.any():
                    x = _matrix(run.column(5), np.int8)[first].astype(np.float32)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    # Who is listed already needn't be sent again; one in twelve others passes for listed and waits for another round.
                    listed = (run.column(4).to_numpy(zero_copy_only=False)[first][:, None] >> (ids % 63)[None, :]) & 1
                    sims = np.where((fresh[:, None] | fresh[None, :]) & (listed == 0), x @ x.T, np.float32(-2))
                    yield _best_of(ids, sims, k, run.column(3).to_numpy(zero_copy_only=False)[first])

        return _grouped_links(parts())

    while True:
        count = lists.agg(F.count(F.lit(1)).alias("n"), F.count_if("new").alias("m")).first()
        if count.m <= changed * count.n:
            return lists.select("src", "dst", "sim")
        mark = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("dst", F.lit(63)).cast("int"))
        least = F.when(F.count(F.lit(1)) == k, F.min("sim")).otherwise(F.lit(floor)).cast("float")
        worst = lists.groupBy(F.col("src").alias("id")).agg(least.alias("worst"), F.bit_or(mark).alias("listed"))
        there = lists.select(F.col("src").alias("center"), F.col("dst").alias("id"), "new")
        both = there.unionByName(lists.select(F.col("dst").alias("center"), F.col("src").alias("id"), "new"))
        if count.m < count.n / 2:
            both = both.join(both.where("new").select("center").distinct(), "center", "left_semi")
        carried = codes.join(worst, "id").select("id", "worst", "listed", "code")
        met = both.join(carried, "id").select("center", "id", "new", "worst", "listed", "code").repartition("center").sortWithinPartitions("center")
        better = met.mapInArrow(meet, "src bigint, dst bigint, sim float").withColumn("new", F.lit(True))
        following = scratch.keep(_shortened(lists.withColumn("new", F.lit(False)).unionByName(better), k))
        scratch.drop(lists)
        lists = following


def sure_links(links: DataFrame, nodes: DataFrame, threshold: float, margin: float = MARGIN) -> DataFrame:
    """Links of at least ``threshold``, each once with a < b; those within ``margin`` are measured with the nodes' vectors."""
    pairs = (
        links.where(F.col("sim") >= threshold - margin)
        .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.max("sim").cast("double").alias("w"))
    )
    unsure = pairs.where(F.col("w") < threshold + margin)
    sure = pairs.where(F.col("w") >= threshold + margin)
    # Asked of the links, not of the pairs, which would be grouped for it.
    if links.where((F.col("sim") >= threshold - margin) & (F.col("sim") < threshold + margin)).isEmpty():
        return sure

    @F.pandas_udf("double")
    def exact(x, y):
        p, q = (np.frombuffer(b"".join(c), np.float16).reshape(-1, DIMENSIONS).astype(np.float64) for c in (x, y))
        import pandas as pd

        return pd.Series((p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1)))

    measured = (
        unsure.join(nodes.select(F.col("id").alias("a"), F.col("vec").alias("x")), "a")
        .join(nodes.select(F.col("id").alias("b"), F.col("vec").alias("y")), "b")
        .select("a", "b", exact("x", "y").alias("w"))
        .where(F.col("w") >= threshold)
    )
    return sure.unionByName(measured)


def communities(links: DataFrame, scratch: Scratch, resolution: float = RESOLUTION) -> DataFrame:
    """(id, label) of the linked nodes, as ``parted`` gives them."""
    labels, between = parted(links, scratch, resolution)
    scratch.drop(between)
    return labels


def parted(links: DataFrame, scratch: Scratch, resolution: float) -> tuple[DataFrame, DataFrame]:
    """(id, label) of the linked nodes: communities merged as long as modularity gains; ``label`` is the least id. And (a, b, w) of links left between labels.

    Merging A and B gains w(A,B)/m - resolution * K(A) * K(B) / (2 m^2), m being
    the weight of all links and K a community's strength. In each round every
    community joins the one it gains most with (ties: least ids), chains of joins
    are followed to the pair that chose each other, and the links are summed up
    between communities. Resolution 0 gives connected components.
    """
    edges = scratch.keep(links)
    total = edges.agg(F.sum("w")).first()[0] or 1.0
    ends = edges.select(F.col("a").alias("id"), "w").unionByName(edges.select(F.col("b").alias("id"), "w"))
    strength = scratch.keep(ends.groupBy("id").agg(F.sum("w").alias("k")))
    labels = scratch.keep(strength.select("id", F.col("id").alias("label")))
    while True:
        ka = strength.select(F.col("id").alias("a"), F.col("k").alias("ka"))
        kb = strength.select(F.col("id").alias("b"), F.col("k").alias("kb"))
        gain = F.col("w") / total - resolution * F.col("ka") * F.col("kb") / (2 * total * total)
        weighed = edges.join(ka, "a").join(kb, "b").withColumn("gain", gain) if resolution else edges.withColumn("gain", F.col("w"))
        weighed = weighed.where("gain > 0").select("a", "b", "gain")
        ways = weighed.select(F.col("a").alias("id"), F.col("b").alias("to"), "gain").unionByName(weighed.select(F.col("b").alias("id"), F.col("a").alias("to"), "gain"))
        chosen = scratch.keep(ways.groupBy("id").agg(F.max_by("to", F.struct("gain", -F.least("id", "to"), -F.greatest("id", "to"))).alias("to")))
        if chosen.isEmpty():
            for done in (chosen, strength):
                scratch.drop(done)
            return labels, edges
        back = chosen.select(F.col("id").alias("to"), F.col("to").alias("id"), F.lit(True).alias("mutual"))
        first = chosen.join(back, ["id", "to"], "left").where(F.col("mutual").isNull() | (F.col("id") > F.col("to")))
        hooks = scratch.keep(first.select("id", "to"))
        scratch.drop(chosen)
        while True:
            ahead = hooks.select(F.col("id").alias("to"), F.col("to").alias("to2"))
            jumped = scratch.keep(hooks.select("id", "to").join(ahead, "to", "left").select("id", F.coalesce("to2", "to").alias("to"), F.col("to2").isNotNull().alias("moved")))
            scratch.drop(hooks)
            hooks = jumped
            if jumped.where("moved").isEmpty():
                break
        # The least id of all that met gives the new label.
        least = hooks.groupBy("to").agg(F.least(F.min("id"), F.col("to")).alias("label"))
        named = hooks.join(least, "to").select("id", F.col("label").alias("to")).unionByName(least.select(F.col("to").alias("id"), F.col("label").alias("to")))
        met, hooks = hooks, scratch.keep(named.where("id != to"))
        scratch.drop(met)
        ha = hooks.select(F.col("id").alias("a"), F.col("to").alias("ta"))
        hb = hooks.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        hl = hooks.select(F.col("id").alias("label"), F.col("to").alias("tl"))
        p, q = F.coalesce("ta", "a"), F.coalesce("tb", "b")
        merged = (
            edges.join(ha, "a", "left")
            .join(hb, "b", "left")
            .select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), "w")
            .where("a < b")
            .groupBy("a", "b")
            .agg(F.sum("w").alias("w"))
        )
        summed = strength.join(hooks.select("id", "to"), "id", "left").groupBy(F.coalesce("to", "id").alias("id")).agg(F.sum("k").alias("k"))
        following = [
            scratch.keep(labels.join(hl, "label", "left").select("id", F.coalesce("tl", "label").alias("label"))),
            scratch.keep(merged),
            scratch.keep(summed) if resolution else strength,
        ]
        for old, new in zip((labels, edges, strength), following):
            if old is not new:
                scratch.drop(old)
        scratch.drop(hooks)
        labels, edges, strength = following


def balls(labelled: DataFrame, threshold: float) -> DataFrame:
    """(ball, label, id, half, alike, center, least): rows of (label, rep, id, half) with a ball of their label that holds them.

    The first row of a ball has its centre and ``least``, the cosine with the
    centre that any vector alike to a row of the ball reaches. Of a label with a
    wide reach each super-node is a ball of its own. ``alike`` rows are surely
    alike with the row that gives the label.
    """
    angle = math.acos(threshold) + 2 * HALF_ANGLE

    def measured(unit: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        size = np.diff(np.append(starts, len(unit)))
        center = np.add.reduceat(unit, starts)
        norm = np.linalg.norm(center, axis=1, keepdims=True)
        center = np.where(norm > 1e-6, center / np.maximum(norm, 1e-6), unit[starts]).astype(np.float16)
        cosine = np.einsum("ij,ij->i", unit, np.repeat(_unit(center), size, axis=0))
        return size, center, np.arccos(np.clip(np.minimum.reduceat(cosine, starts), -1, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_of, head = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            label, rep, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            unit = _unit(_matrix(batch.column(3)))
            first = np.concatenate([[True], label[1:] != label[:-1]])
            runs = np.flatnonzero(first)
            size, _, reach = measured(unit, runs)
            # The row that gives a label is its first; a label that began before this batch has it from there, or not at all.
            heads, known = unit[runs], ids[runs] == label[runs]
            if not known[0] and head_of == label[0]:
                heads[0], known[0] = head, True
            head_of, head = (label[-1], heads[-1].copy()) if known[-1] else (None, None)
            alike = (np.einsum("ij,ij->i", unit, np.repeat(heads, size, axis=0)) >= threshold + MARGIN) & np.repeat(known, size)
            wide = np.repeat(reach > WIDE, size)
            starts = np.flatnonzero(first | (wide & np.concatenate([[True], rep[1:] != rep[:-1]])))
            size, center, reach = measured(unit, starts)
            centers, leasts = [None] * len(ids), [None] * len(ids)
            for at, c, v in zip(starts.tolist(), center, np.cos(np.minimum(math.pi, reach + angle)).tolist()):
                centers[at], leasts[at] = c.tobytes(), v
            columns = [pa.array(np.repeat(ids[starts], size)), batch.column(0), batch.column(2), batch.column(3), pa.array(alike), pa.array(centers, pa.binary()), pa.array(leasts, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["ball", "label", "id", "half", "alike", "center", "least"])

    ordered = labelled.select("label", "rep", "id", "half").repartitionByRange("label", "rep", "id").sortWithinPartitions("label", "rep", "id")
    return ordered.mapInArrow(run, "ball bigint, label bigint, id bigint, half binary, alike boolean, center binary, least double")


def near_balls(balled: DataFrame, most: int = 262_144) -> DataFrame:
    """(id, label, ball, code): each row, with its vector in 8-bit numbers, and every ball of a greater label that may hold a row alike to it.

    Balls' rows are spread over blocks and centres over parts of about ``most``; each
    block meets each part in a task that holds the part and lets the block pass.
    What passes of a ball is a ball itself: its centre is compared first, its rows
    only with the centres that are as near as its reach and the other's allow.
    """
    n, m = balled.agg(F.count(F.lit(1)), F.count("center")).first()
    parts = max(1, -(-m // most))
    # Each block gets a copy of the centres: copies take at most half the rows' room, more only for the work.
    tasks = max(min(balled.sparkSession.sparkContext.defaultParallelism, n // max(1, 2 * m)), m * m // 10_000_000_000)
    blocks = max(1, -(-tasks // parts))
    of = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    held = balled.where("center IS NOT NULL").select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), of("ball", parts).alias("part"), F.lit(0).alias("side"), "label", "ball", F.col("ball").alias("id"), F.col("center").alias("vec"), "least"
    )
    passing = balled.select(
        of("ball", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("side"), "label", "ball", "id", F.col("half").alias("vec"), F.lit(None).cast("double").alias("least")
    )

    def with_reach(center: np.ndarray, reach: np.ndarray, sign: int) -> np.ndarray:
        """Columns that take cos(r + s) off the product of centres with reaches r and s, as cos r cos s - sin r sin s."""
        return np.column_stack([center, sign * np.cos(reach), np.sin(reach)]).astype(np.float32)

    def near_pairs(unit: np.ndarray, starts: np.ndarray, cosines: np.ndarray, limit: np.ndarray, extended: np.ndarray, furthest: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, centre) with a cosine of at least the centre's limit; rows of a ball begin at each of ``starts``."""
        size = np.diff(np.append(starts, len(unit)))
        middle = np.add.reduceat(unit, starts)
        norm = np.linalg.norm(middle, axis=1, keepdims=True)
        middle = np.where(norm > 1e-6, middle / np.maximum(norm, 1e-6), unit[starts])
        reach = np.arccos(np.clip(np.minimum.reduceat(np.einsum("ij,ij->i", unit, np.repeat(middle, size, axis=0)), starts), -1, 1))
        rows, own = unit.astype(np.float32), with_reach(middle, reach, -1)
        whole = reach.max() + furthest >= math.pi
        for c in range(0, len(limit), 2048):
            other = cosines[c : c + 2048]
            if not whole:
                g, j = np.divmod(np.flatnonzero(own @ extended[c : c + 2048].T >= -1e-5), len(other))
                if not len(g):
                    continue
                k = size[g]
                if k.sum() * 16 <= len(rows) * len(other):
                    j, i = np.repeat(j, k), np.repeat(starts[g] - np.cumsum(k) + k, k) + np.arange(k.sum())
                    near = np.einsum("ij,ij->i", rows[i], other[j]) >= limit[c + j]
                    yield i[near], j[near] + c
                    continue
            i, j = np.divmod(np.flatnonzero(rows @ other.T >= limit[c : c + 2048]), len(other))
            yield i, j + c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, collected, centers = None, [], None
        for batch in batches:
            block, part, side, label, ball, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(6))
            cuts = (np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                if lo == hi:
                    continue
                if cell != (block[lo], part[lo]):
                    cell, collected, centers = (block[lo], part[lo]), [], None
                unit = _unit(_matrix(batch.column(6).slice(lo, hi - lo)))
                if side[lo] == 0:
                    collected.append((label[lo:hi], ids[lo:hi], unit.astype(np.float32), batch.column(7).slice(lo, hi - lo).to_numpy(zero_copy_only=False)))
                    continue
                if not collected:
                    continue
                if centers is None:
                    centers, collected = tuple(np.concatenate(c) for c in zip(*collected)), [True]
                    limit = (centers[3] - 1e-5).astype(np.float32)
                    reach = np.arccos(np.clip(centers[3], -1, 1))
                    extended = with_reach(centers[2], reach, 1)
                for r in range(lo, hi, 1024):
                    end = min(hi, r + 1024)
                    after = int(np.searchsorted(centers[0], label[r], "right"))
                    if after == len(limit):
                        continue
                    starts = np.concatenate([[0], np.flatnonzero(ball[r + 1 : end] != ball[r : end - 1]) + 1])
                    for i, j in near_pairs(unit[r - lo : end - lo], starts, centers[2][after:], limit[after:], extended[after:], float(reach[after:].max())):
                        i, j = i + r, j + after
                        ahead = centers[0][j] > label[i]
                        if ahead.any():
                            i, j = i[ahead], j[ahead]
                            code = _cells(np.rint(unit[i - lo] * 127).astype(np.int8))
                            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(label[i]), pa.array(centers[1][j]), code], names=["id", "label", "ball", "code"])

    spread = held.unionByName(passing).repartition(4 * blocks * parts, "block", "part").sortWithinPartitions("block", "part", "side", "label", "ball")
    return spread.mapInArrow(run, "id bigint, label bigint, ball bigint, code binary")


def given_vectors(rows: DataFrame, key: str, vector: str, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, raw) of the usable rows with an id of ``wanted``: the vectors without loss. Ids are written first: of few, the planner then knows it and moves no row for the join."""
    kind, ids = _raw_kind(rows, vector), scratch.keep(wanted.select("id").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _usable(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), _cells(x.astype(kind))], names=["id", "raw"])

    return rows.select(F.col(key).cast("bigint").alias("id"), vector).join(ids, "id", "left_semi").mapInArrow(run, "id bigint, raw binary")


def ball_links(near: DataFrame, balled: DataFrame, given: Callable[[DataFrame], DataFrame], kind: type, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b, w): pairs of labels of which a row and a row of a ball near it are alike. What isn't clear by the rounded vectors is measured with the ``given`` vectors of those ids."""

    def rough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sims = _cosines(_matrix(batch.column(4), np.int8), _matrix(batch.column(5)))
            keep = pa.array(np.flatnonzero(sims >= threshold - CODE_BOUND))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(keep) for c in range(4)], pa.array(sims).take(keep)], names=["a", "b", "id", "other", "sim"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = pa.array(np.flatnonzero(_cosines(_matrix(batch.column(2), kind), _matrix(batch.column(3), kind)) >= threshold))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in range(2)], names=["a", "b"])

    ends = near.join(balled.select("ball", F.col("label").alias("b"), F.col("id").alias("other"), F.col("half").alias("other_half")), "ball")
    pairs = ends.select(F.col("label").alias("a"), "b", "id", "other", "code", "other_half")
    alike = scratch.keep(pairs.mapInArrow(rough, "a bigint, b bigint, id bigint, other bigint, sim double"))
    sure = alike.where(F.col("sim") >= threshold + CODE_BOUND).select("a", "b").distinct()
    unsure = alike.where(F.col("sim") < threshold + CODE_BOUND).join(sure, ["a", "b"], "left_anti")
    if unsure.isEmpty():
        return sure.withColumn("w", F.lit(1.0))
    raw = given(unsure.select("id").unionByName(unsure.select(F.col("other").alias("id"))))
    full = unsure.join(raw, "id").join(raw.select(F.col("id").alias("other"), F.col("raw").alias("other_raw")), "other").select("a", "b", "raw", "other_raw")
    return sure.unionByName(full.mapInArrow(exact, "a bigint, b bigint").distinct()).withColumn("w", F.lit(1.0))


def _relabelled(labelled: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels with links among them become their least."""
    joined = communities(links, scratch, 0.0).select(F.col("id").alias("label"), F.col("label").alias("_l"))
    return labelled.join(joined, "label", "left").withColumn("was", F.col("label")).withColumn("label", F.coalesce("_l", "label")).drop("_l")


def _with_heads(balled: DataFrame, threshold: float) -> DataFrame:
    """(id, label, alike): rows that didn't see the row of their label, as it was in another task, are compared with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alike = _cosines(_matrix(batch.column(2)), _matrix(batch.column(3))) >= threshold + MARGIN
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike)], names=["id", "label", "alike"])

    missing = balled.where("NOT alike")
    heads = balled.where("id = label").join(missing.select("label").distinct(), "label", "left_semi").select("label", F.col("half").alias("head"))
    seen = missing.join(heads, "label").select("id", "label", "half", "head").mapInArrow(run, "id bigint, label bigint, alike boolean")
    return balled.where("alike").select("id", "label", "alike").unionByName(seen)


def cluster(
    rows: DataFrame, key: str = "faiss_id", vector: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK, resolution: float = RESOLUTION
) -> DataFrame:
    """(id, cluster_id, alike) of every usable vector; ``cluster_id`` is the least id of its group, its own if alone.

    Two vectors with a cosine of at least ``threshold`` are in the same group,
    whatever lies between. ``alike``: surely alike with the row of that id (false
    may be so by a hair or not at all). Null, short, long, non-finite and all-zero
    vectors are in no group, nor are rows without id. Equal vectors are alike. An
    empty table gives an empty result.
    """
    scratch = Scratch(rows.sparkSession, "clusters")
    # What is doubtful isn't gathered here; the check measures it.
    members = scratch.keep(contract_blocks(rows, key, vector, threshold + MARGIN, block))
    nodes, passes = members.where("leads").select("id", "vec"), []
    for seed in range(CELL_PASSES):
        passes.append(scratch.keep(contract_cells(nodes, threshold + MARGIN, seed, max(BUCKET, block))))
        nodes = passes[-1].where("vec IS NOT NULL").select("id", "vec")
    lists = scratch.keep(neighbour_descent(nodes, scratch, threshold))
    found, between = parted(sure_links(lists, nodes, threshold + MARGIN, LIST_BOUND), scratch, resolution)
    labels = found
    for led in reversed(passes):
        named = led.select("id", "rep").join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left")
        labels = named.select("id", F.coalesce("label", "rep").alias("label"))
    if not between.isEmpty():
        labels = _relabelled(labels, between, scratch).select("id", "label")
    labels = labels.groupBy(F.col("id").alias("rep")).agg(F.min("label").alias("label"))
    labelled = members.select("id", "rep", F.col("vec").alias("half")).join(labels, "rep")
    balled = scratch.keep(balls(labelled, threshold))
    for done in (members, lists, found, between, *passes):
        scratch.drop(done)
    near = scratch.keep(near_balls(balled))
    result = _with_heads(balled, threshold)
    if not near.isEmpty():
        given = lambda ids: given_vectors(rows, key, vector, ids, scratch)
        late = scratch.keep(ball_links(near, balled, given, _raw_kind(rows, vector), threshold, scratch))
        if not late.isEmpty():
            result = _relabelled(result, late, scratch).withColumn("alike", F.col("alike") & (F.col("label") == F.col("was")))
    joined = scratch.keep(result.select("id", F.col("label").alias("cluster_id"), "alike"))
    # Labels are least ids already: leaders, communities and joins all keep the least.
    for done in (balled, near):
        scratch.drop(done)
    return joined


def least_alike(clustered: DataFrame, rows: DataFrame, key: str = "faiss_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(cluster_id, id) of the rows in groups of at least two; ``cluster_id`` is the least id that the row itself is alike with.

    It is the group's least id wherever all of a group are alike. Rows that
    aren't surely alike with that one are measured with it, and those that aren't
    alike with it are measured with the others of their group.
    """
    kind = _raw_kind(rows, vector)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alike = _cosines(_matrix(batch.column(2), kind), _matrix(batch.column(3), kind)) >= threshold
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike)], names=["cluster_id", "id", "alike"])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, others = None, [], None
        for batch in batches:
            group, salt, side, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            cuts = (np.flatnonzero((group[1:] != group[:-1]) | (salt[1:] != salt[:-1]) | (side[1:] != side[:-1])) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                if lo == hi:
                    continue
                if cell != (group[lo], salt[lo]):
                    cell, held, others = (group[lo], salt[lo]), [], None
                now = (ids[lo:hi], _matrix(batch.column(4).slice(lo, hi - lo), kind))
                if side[lo] == 0:
                    held.append(now)
                    continue
                if others is None:
                    others = tuple(np.concatenate(c) for c in zip(*held))
                    unit = _unit(others[1])
                asked, label = _unit(now[1]), now[0].copy()
                for r in range(0, len(label), 256):
                    for c in range(0, len(unit), 4096):
                        open_ = np.flatnonzero(label[r : r + 256] > others[0][c]) + r
                        if not len(open_):
                            break
                        sims = asked[open_] @ unit[c : c + 4096].T
                        alike = sims >= threshold + 1e-9
                        i, j = np.nonzero(~alike & (sims >= threshold - 1e-9))
                        alike[i, j] = _cosines(now[1][open_[i]], others[1][c + j]) >= threshold
                        some = alike.any(axis=1)
                        label[open_[some]] = np.minimum(label[open_[some]], others[0][c + alike[some].argmax(axis=1)])
                yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(now[0])], names=["cluster_id", "id"])

    members = _of_groups(clustered)
    alike = members.where("alike").select("cluster_id", "id")
    asking = clustered.where("NOT alike").select("cluster_id", "id")
    if asking.isEmpty():
        return alike
    scratch = Scratch(rows.sparkSession, "least")
    raw = given_vectors(rows, key, vector, asking.select("id").unionByName(asking.select(F.col("cluster_id").alias("id"))), scratch)
    pairs = asking.join(raw, "id").join(raw.select(F.col("id").alias("cluster_id"), F.col("raw").alias("head")), "cluster_id").select("cluster_id", "id", "raw", "head")
    seen = scratch.keep(pairs.mapInArrow(headed, "cluster_id bigint, id bigint, alike boolean"))
    alike = alike.unionByName(seen.where("alike").select("cluster_id", "id"))
    still = seen.where("NOT alike")
    if still.isEmpty():
        return alike
    # One copy of a group per thousand rows that ask.
    copies = still.groupBy("cluster_id").agg(F.least(F.lit(SALTS), F.ceil(F.count(F.lit(1)) / 1024)).cast("int").alias("copies"))
    whole = clustered.select("cluster_id", "id").join(copies, "cluster_id")
    own = whole.join(given_vectors(rows, key, vector, whole, scratch), "id")
    held = own.select("cluster_id", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("side"), "id", "raw")
    asks = own.join(still.select("id"), "id", "left_semi")
    passing = asks.select("cluster_id", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int").alias("salt"), F.lit(1).alias("side"), "id", "raw")
    ordered = held.unionByName(passing).repartition("cluster_id", "salt").sortWithinPartitions("cluster_id", "salt", "side", "id")
    return alike.unionByName(ordered.mapInArrow(least, "cluster_id bigint, id bigint"))


def _of_groups(clustered: DataFrame) -> DataFrame:
    sizes = clustered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("cluster_id")
    return clustered.join(sizes, "cluster_id")


def grouped(clustered: DataFrame) -> DataFrame:
    """(cluster_id, id) of the rows in groups of at least two."""
    return _of_groups(clustered).select("cluster_id", "id")


def with_degrees(clustered: DataFrame, rows: DataFrame, key: str = "faiss_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster_id, degree) of the rows in groups of at least two; ``degree`` sums the cosines to all other members.

    All pairs of a group are linked, so with unit vectors a member's degree is
    its product with the sum of the group's, less its own 1.
    """

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _usable(batches):
            unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([u.tobytes() for u in unit], pa.binary())], names=["id", "unit"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            total = np.zeros((len(group), DIMENSIONS))
            np.add.at(total, at, _matrix(batch.column(1), np.float32).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(list(total), pa.list_(pa.float64()))], names=["cluster_id", "total"])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
            degree = (_matrix(batch.column(2), np.float32).astype(np.float64) * totals).sum(axis=1) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(degree)], names=["id", "cluster_id", "degree"])

    vectors = rows.select(F.col(key).cast("bigint").alias("id"), vector).mapInArrow(units, "id bigint, unit binary")
    labelled = grouped(clustered).join(vectors, "id").select("id", "cluster_id", "unit")
    sums = (
        labelled.select("cluster_id", "unit")
        .mapInArrow(partial, "cluster_id bigint, total array<double>")
        .groupBy("cluster_id")
        .agg(F.array(*[F.sum(F.col("total")[i]) for i in range(DIMENSIONS)]).alias("total"))
    )
    joined = labelled.join(sums, "cluster_id").select("id", "cluster_id", "unit", "total")
    return joined.mapInArrow(product, "id bigint, cluster_id bigint, degree double")


def describe(clustered: DataFrame, rows: DataFrame, key: str = "faiss_id", typical: int = 3, salts: int = 16) -> DataFrame:
    """(cluster_id, n_members, typical_ids, species, n_species_rows) per group of at least two.

    ``typical_ids`` have the highest internal weighted degree (ties: least id),
    ``species`` is the cleaned name most members have. Best members are found
    per salt first, so that no task sorts a whole large group.
    """
    from cladeflow.functions.text import taxon_name

    scratch = Scratch(rows.sparkSession, "degrees")
    degrees = scratch.keep(with_degrees(clustered, rows, key))
    named = degrees.join(rows.select(F.col(key).alias("id"), taxon_name(F.col("species")).alias("species")), "id")
    salted = named.withColumn("salt", F.pmod(F.hash("id"), F.lit(salts)))
    order = [F.desc("degree"), "id"]
    w1 = Window.partitionBy("cluster_id", "salt").orderBy(*order)
    w2 = Window.partitionBy("cluster_id").orderBy(*order)
    best = salted.withColumn("r", F.row_number().over(w1)).where(F.col("r") <= typical)
    best = best.withColumn("r", F.row_number().over(w2)).where(F.col("r") <= typical)
    tops = best.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("typical_ids"))
    votes = named.groupBy("cluster_id", "species").agg(F.count(F.lit(1)).alias("n"))
    sizes = votes.groupBy("cluster_id").agg(
        F.sum("n").alias("n_members"),
        F.max(F.when(F.col("species").isNotNull(), F.struct(F.col("n"), F.col("species")))).alias("best"),
    )
    return sizes.where("n_members >= 2").join(tops, "cluster_id").select(
        "cluster_id", "n_members", "typical_ids", F.col("best.species").alias("species"), F.col("best.n").alias("n_species_rows")
    )
