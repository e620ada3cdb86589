"""Sequence expressions: cleaning, primers, windows, ambiguity and distances."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.functions.vectors import bind

# IUPAC codes with the bases they stand for, and their complements.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT", "I": "ACGT",
}
CODES, COMPLEMENTS = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"


@dataclass(frozen=True)
class Primers:
    """A primer pair and the window length it aims at; without ``reverse`` the window runs to the end."""

    name: str
    forward: str
    reverse: str
    target: int
    shortest: int
    longest: int


# Published primer sets.
PRIMER_SETS = {
    p.name: p
    for p in (
        Primers("leray", "GGWACWGGWTGAACWGTWTAYCCYCC", "", 313, 280, 400),
        Primers("folmer", "GGTCAACAAATCATAAAGATATTGG", "TAAACTTCAGGGTGACCAAAAAATCA", 658, 550, 750),
        Primers("zeale", "AGATATTGGAACWTTATATTTTATTTTTGG", "WACTAATCAATTWCCAAATCCTCC", 157, 130, 200),
        Primers("elbrecht_bf2", "GCHCCHGAYATRGCHTTYCC", "", 440, 380, 500),
    )
}


def iupac_regex(primer: str) -> str:
    return "".join(b if len(b) == 1 else f"[{b}]" for b in (IUPAC.get(c, c) for c in primer.upper()))


def reverse_complement_text(primer: str) -> str:
    return primer.upper().translate(str.maketrans(CODES, COMPLEMENTS))[::-1]


def clean_sequence(cell: Column) -> Column:
    """Letters only, in capitals."""
    return F.upper(F.regexp_replace(cell, "[^A-Za-z]", ""))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, CODES + CODES.lower(), COMPLEMENTS + COMPLEMENTS.lower()))


def ambiguity_count(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[ACGT]", ""))


def crop(seq: Column, start: int, end: int) -> Column:
    """Letters from ``start`` to before ``end``; empty beyond the sequence."""
    return F.substring(seq, start + 1, end - start)


def wrap(seq: Column, width: int = 80) -> Column:
    """Lines of ``width`` letters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?!$)", "$1\n")


def _hits(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, primer: str, mismatches: int, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, mismatches) of the leftmost best fit of each sequence at or behind ``after``; start -1 if there is none.

    The sequences lie end to end in ``codes``, so one pass per primer letter
    counts mismatches at every place of all of them. Exact fits come first.
    """
    n = len(primer)
    found, miss = np.full(len(starts), -1), np.zeros(len(starts), np.int64)
    places = len(codes) - n + 1
    if places <= 0:
        return found, miss
    missed = np.zeros(places, np.int16)
    for k, letter in enumerate(primer.upper()):
        fits = np.zeros(256, bool)
        fits[np.frombuffer(IUPAC.get(letter, letter).encode(), np.uint8)] = True
        missed += ~fits[codes[k : k + places]]
    for most in sorted({0, mismatches}):
        at = np.flatnonzero(missed <= most)
        owner = np.searchsorted(starts, at, side="right") - 1
        good = (at - starts[owner] >= after[owner]) & (at + n <= starts[owner] + lengths[owner]) & (found[owner] < 0)
        owner, first = np.unique(owner[good], return_index=True)
        found[owner] = at[good][first] - starts[owner]
        miss[owner] = missed[at[good][first]]
    return found, miss


def primer_hits(forward: str, reverse: str, mismatches: int):
    """A pandas UDF: struct(fs, fm, rs, rm), where the primers start and their mismatches, -1 where there is none.

    The reverse primer is sought behind the forward one first, then anywhere.
    """
    back = reverse_complement_text(reverse)

    @F.pandas_udf("struct<fs:int,fm:int,rs:int,rm:int>")
    def search(seqs: pd.Series) -> pd.DataFrame:
        texts = [t.encode("ascii", "replace") if t else b"" for t in seqs]
        lengths = np.array([len(t) for t in texts], np.int64)
        # A sign no primer fits stands behind each sequence, so that none is empty.
        codes = np.frombuffer(b"".join(t + b"-" for t in texts), np.uint8)
        starts = np.cumsum(lengths + 1) - lengths - 1
        zero = np.zeros(len(texts), np.int64)
        fs, fm = _hits(codes, starts, lengths, forward, mismatches, zero)
        rs, rm = np.full(len(texts), -1), zero
        if reverse:
            behind = np.where(fs >= 0, fs + len(forward), lengths + 1)
            rs, rm = _hits(codes, starts, lengths, back, mismatches, behind)
            any_rs, any_rm = _hits(codes, starts, lengths, back, mismatches, zero)
            rs, rm = np.where(rs >= 0, rs, any_rs), np.where(rs >= 0, rm, any_rm)
        return pd.DataFrame({"fs": fs, "fm": fm, "rs": rs, "rm": rm}).astype("int32")

    return search


def find_primer(seq: Column, primer: str, after: Column | None = None) -> Column:
    """struct(start, end, mismatches) of the leftmost exact fit of a primer at or behind ``after``, null if there is none."""
    after = F.lit(0) if after is None else after
    rest = seq.substr(after + 1, F.length(seq))
    at = F.regexp_instr(rest, F.lit(iupac_regex(primer)))
    return F.when(at > 0, _hit(after + at - 1, len(primer), F.lit(0)))


def _hit(start: Column, length: int, miss: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), (start + length).cast("int").alias("end"), miss.cast("int").alias("mismatches"))


def window_metrics(s: Column, f: Column, r: Column, primers: Primers) -> Column:
    """The window of a sequence between two primer hits, and how well it is supported, as a struct; null for a null sequence.

    primer_support, primer_mismatches, coverage_rank, window_start, window_end,
    window_length, ambiguity_count, ambiguity_fraction (1 for an empty window),
    tiebreak_length.
    """
    window = lambda support, miss, start, end: F.struct(F.lit(support).alias("support"), miss.alias("miss"), start.alias("start"), end.alias("end"))
    start, end = F.lit(0), F.length(s)
    placed = (
        F.when(f.isNotNull() & r.isNotNull() & (r["start"] > f["end"]), window("both", f["mismatches"] + r["mismatches"], f["end"], r["start"]))
        .when(f.isNotNull(), window("forward_only", f["mismatches"], f["end"], end))
        .when(r.isNotNull(), window("reverse_only", r["mismatches"], start, r["start"]))
        .otherwise(window("none", F.lit(0), start, end))
    )

    def measured(w: Column, ambiguous: Column) -> Column:
        support, length = w["support"], w["end"] - w["start"]
        plausible = length.between(primers.shortest, primers.longest)
        if primers.reverse:
            rank = F.when((support == "both") & plausible, 0).when(support == "both", 1).when(support != "none", 2).otherwise(3)
        else:
            rank = F.when((support == "forward_only") & plausible, 0).when(support == "forward_only", 1).otherwise(3)
        return F.struct(
            support.alias("primer_support"),
            w["miss"].alias("primer_mismatches"),
            rank.alias("coverage_rank"),
            w["start"].alias("window_start"),
            w["end"].alias("window_end"),
            length.alias("window_length"),
            ambiguous.alias("ambiguity_count"),
            F.when(length > 0, ambiguous / length).otherwise(F.lit(1.0)).alias("ambiguity_fraction"),
            F.when(support == "none", -length).otherwise(F.abs(length - primers.target)).alias("tiebreak_length"),
        )

    counted = bind(placed, lambda w: bind(ambiguity_count(s.substr(w["start"] + 1, w["end"] - w["start"])), lambda d: measured(w, d)))
    return F.when(s.isNotNull(), counted)


def assess_window(rows: DataFrame, cell: str, primers: Primers, mismatches: int = 0, out: str = "metrics") -> DataFrame:
    """Adds ``out``: ``window_metrics`` of a sequence column between the primers of a set.

    Of fits an exact one anywhere is taken before one with mismatches, then the
    leftmost; the reverse primer is sought behind the forward one first. Every
    step is bound once and a generator closes the row, so that no expression is
    evaluated again by its uses.
    """
    others = [c for c in rows.columns if c != cell]

    def closed(s: Column, metrics: Column) -> Column:
        return F.struct(s.alias(cell), metrics.alias(out))

    if mismatches > 0:
        hits = F.col("_h")
        rows = rows.withColumn("_h", primer_hits(primers.forward, primers.reverse, mismatches)(F.col(cell)))
        f = F.when(hits["fs"] >= 0, _hit(hits["fs"], len(primers.forward), hits["fm"]))
        r = F.when(hits["rs"] >= 0, _hit(hits["rs"], len(primers.reverse), hits["rm"]))
        parsed = bind(F.col(cell), lambda s: bind(f, lambda a: bind(r, lambda b: closed(s, window_metrics(s, a, b, primers)))))
    else:

        def backward(s: Column, f: Column) -> Column:
            if not primers.reverse:
                return F.lit(None).cast("struct<start:int,end:int,mismatches:int>")
            back = reverse_complement_text(primers.reverse)
            return F.coalesce(find_primer(s, back, F.coalesce(f["end"], F.length(s) + 1)), find_primer(s, back))

        parsed = bind(F.col(cell), lambda s: bind(find_primer(s, primers.forward), lambda f: bind(backward(s, f), lambda r: closed(s, window_metrics(s, f, r, primers)))))
    return rows.select(*others, F.inline(F.array(parsed)))


def site_counts(a: Column, b: Column) -> Column:
    """struct(sites, ts, tv): compared sites, transitions and transversions of two aligned sequences.

    Sites where either isn't one of ACGT are left out; the longer one's tail
    too. A null sequence has no sites.
    """
    return F.pandas_udf(_site_counts, "struct<sites:int,ts:int,tv:int>")(a, b)


def _site_counts(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    left, right = ([t.encode("ascii", "replace") if t else b"" for t in c] for c in (a, b))
    lengths = np.array([min(len(x), len(y)) for x, y in zip(left, right)], np.int64)
    class_of = np.zeros(256, np.int8)
    for code, letter in zip((1, 2, 5, 6), b"AGCT"):  # purines 1 and 2, pyrimidines 5 and 6
        class_of[letter] = code
    x = class_of[np.frombuffer(b"".join(t[:n] for t, n in zip(left, lengths)), np.uint8)]
    y = class_of[np.frombuffer(b"".join(t[:n] for t, n in zip(right, lengths)), np.uint8)]
    both = (x > 0) & (y > 0)
    differ = both & (x != y)
    within = (x >> 2) == (y >> 2)
    ends = np.cumsum(lengths)
    total = lambda mask: (sums := np.concatenate([[0], np.cumsum(mask)]))[ends] - sums[ends - lengths]
    return pd.DataFrame({"sites": total(both), "ts": total(differ & within), "tv": total(differ & ~within)}).astype("int32")


# Letters as 0 to 3 (purines A, G; pyrimidines C, T), all else 4; a stretch's three counts fit one product of 32-bit floats.
_LETTER = np.full(256, 4, np.uint8)
_LETTER[np.frombuffer(b"AGCT", np.uint8)] = range(4)
_ONE = np.eye(5, 4, dtype=np.float32)
_SAME_CLASS = np.kron(np.eye(2), np.ones((2, 2))).astype(np.float32)
STRETCH = 255
FEW_PAIRS = 4096


def _letters(cells: list[str]) -> np.ndarray:
    """Sequences as rows of letter codes, filled up with 4."""
    texts = [t.encode("ascii", "replace") for t in cells]
    width = max(map(len, texts), default=0)
    return _LETTER[np.frombuffer(b"".join(t.ljust(width, b"-") for t in texts), np.uint8)].reshape(len(texts), width)


def _counted(key: np.ndarray, radix: int, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sites, ts, tv, n) of keys that hold sites, sites of the same class and alike sites as digits."""
    sites, same, alike = key % radix, key // radix % radix, key // radix**2
    return sites, same - alike, sites - same, n


def _all_counts(a: np.ndarray, b: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(sites, ts, tv, n): how many pairs of a row of ``a`` with one of ``b`` (those of ``keep``) have these counts, by matrix products."""
    width = min(a.shape[1], b.shape[1])
    radix, key = width + 1, 0
    for lo in range(0, max(1, width), STRETCH):
        x, y = a[:, lo : min(lo + STRETCH, width)], b[:, lo : min(lo + STRETCH, width)]
        r = x.shape[1] + 1
        weigh = np.vstack([1 + r * _SAME_CLASS + r * r * np.eye(4, dtype=np.float32), np.zeros((1, 4), np.float32)])
        part = _ONE[x].reshape(len(x), -1) @ weigh[y].reshape(len(y), -1).T
        part = (part if keep is None else part[keep]).ravel().astype(np.int32 if width <= STRETCH else np.int64)
        key = key + (part if r == radix else part % r + radix * (part // r % r) + radix**2 * (part // r**2))
    if width <= STRETCH:
        n = np.bincount(key)
        at = np.flatnonzero(n)
        return _counted(at, radix, n[at])
    at, n = np.unique(key, return_counts=True)
    return _counted(at, radix, n)


def _pair_counts(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sites, ts, tv, n) of each of the pairs of rows ``a`` and ``b``."""
    x, y = codes[a], codes[b]
    both = (x < 4) & (y < 4)
    same, alike = both & (x >> 1 == y >> 1), both & (x == y)
    sites, same, alike = (np.count_nonzero(m, axis=1) for m in (both, same, alike))
    return sites, same - alike, sites - same, np.ones(len(a), np.int64)


def _run_counts(run: pa.Table, every: int) -> Iterator[pa.RecordBatch]:
    """Counts of whole runs of (group, salt, asked, key, cell), those asked first in each run."""
    group = run.column(0).combine_chunks()
    code = group.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    salt, other, key = (run.column(c).to_numpy() for c in (1, 2, 3))
    starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (salt[1:] != salt[:-1])]))
    ends = np.append(starts[1:], len(code))
    before = np.concatenate([[0], np.cumsum(other)])
    n_b = before[ends] - before[starts]
    n_a = ends - starts - n_b
    cells = run.column(4)

    def batch(at: np.ndarray | int, counts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        at = np.broadcast_to(at, len(counts[0]))
        columns = [group.take(pa.array(at)), *[pa.array(c.astype(np.int32)) for c in counts[:3]], pa.array(counts[3].astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["group", "sites", "ts", "tv", "n"])

    few = np.flatnonzero((n_a > 0) & (n_b > 0) & (n_a * n_b <= FEW_PAIRS))
    while len(few):
        # As many small runs at once as give some 100,000 pairs.
        most = max(1, int(np.searchsorted(np.cumsum(n_a[few] * n_b[few]), 100_000)))
        now, few = few[:most], few[most:]
        pairs = n_a[now] * n_b[now]
        of = np.repeat(np.arange(len(now)), pairs)
        nth = np.arange(len(of)) - (np.cumsum(pairs) - pairs)[of]
        a = starts[now][of] + nth // n_b[now][of]
        b = (starts + n_a)[now][of] + nth % n_b[now][of]
        kept = (key[b] > key[a]) | ((key[b] < key[a]) & (key[b] % every != 0))
        a, b = a[kept], b[kept]
        if len(a):
            lo, hi = int(starts[now[0]]), int(ends[now[-1]])
            yield batch(a, _pair_counts(_letters(cells.slice(lo, hi - lo).to_pylist()), a - lo, b - lo))
    for r in np.flatnonzero((n_a > 0) & (n_b > 0) & (n_a * n_b > FEW_PAIRS)):
        lo, middle, hi = int(starts[r]), int(starts[r] + n_a[r]), int(ends[r])
        for b in range(middle, hi, 4096):
            at = np.arange(b, min(b + 4096, hi))
            right = _letters(cells.slice(b, len(at)).to_pylist())
            asking = key[at] % every == 0
            for a in range(lo, middle, 512):
                left = _letters(cells.slice(a, min(512, middle - a)).to_pylist())
                if not asking.all():
                    yield batch(lo, _all_counts(left, right[~asking]))
                later = key[at][asking][None, :] > key[a : a + len(left)][:, None]
                if later.any():
                    yield batch(lo, _all_counts(left, right[asking], later))


def site_counts_within_groups(rows: DataFrame, group: str, key: str, cell: str, every: int, salts: int = 16) -> DataFrame:
    """(group, sites, ts, tv, n): how many of the pairs of ``pairing.within_groups`` have these ``site_counts``.

    No pair becomes a row: those of a large group are counted by matrix products,
    in ``salts`` tasks at least. Sequences are text without null.
    """
    sound = rows.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(cell).isNotNull()).select(F.col(group).alias("group"), F.col(key).cast("bigint").alias("key"), F.col(cell).alias("cell"))
    # One scan gives both: each row as the other of its salt, and if it asks, for every salt.
    other = F.array(F.struct(F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("other")))
    asked = F.array(*[F.struct(F.lit(s).alias("salt"), F.lit(0).alias("other")) for s in range(salts)])
    spread = sound.select("group", "key", "cell", F.inline(F.when(F.col("key") % every == 0, F.concat(other, asked)).otherwise(other)))
    ordered = spread.select("group", "salt", "other", "key", "cell").repartition("group", "salt").sortWithinPartitions("group", "salt", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        mark = lambda b, i: (b.column(0)[i].as_py(), b.column(1)[i].as_py())
        for batch in batches:
            if not batch.num_rows:
                continue
            last = mark(batch, batch.num_rows - 1)
            if held and mark(held[0], 0) == last:
                held.append(batch)
                continue
            change = batch.num_rows - 1
            while change and mark(batch, change - 1) == last:
                change -= 1
            yield from _run_counts(pa.Table.from_batches([*held, batch.slice(0, change)]), every)
            held = [batch.slice(change)]
        if held:
            yield from _run_counts(pa.Table.from_batches(held), every)

    kind = sound.schema["group"].dataType.simpleString()
    return ordered.mapInArrow(run, f"group {kind}, sites int, ts int, tv int, n bigint").withColumnRenamed("group", group)


def distance(counts: Column, model: str, min_sites: int = 1) -> Column:
    """p, jc69 or k2p distance of ``site_counts``; null with too few sites or where the model has no value."""
    n = counts["sites"]
    p, q = counts["ts"] / n, counts["tv"] / n
    if model == "p":
        value = p + q
    elif model == "jc69":
        x = 1 - 4 * (p + q) / 3
        value = F.when(x > 0, -0.75 * F.log(x))
    elif model == "k2p":
        x, y = 1 - 2 * p - q, 1 - 2 * q
        value = F.when((x > 0) & (y > 0), -0.5 * F.log(x) - 0.25 * F.log(y))
    else:
        raise ValueError(f"no such model: {model}")
    return F.when(n >= max(1, min_sites), value)
