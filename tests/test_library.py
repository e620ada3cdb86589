"""Sequence, vector and tree helpers against known answers, and the driver's contract."""

import numpy as np
from pyspark.sql import functions as F

from cladeflow.functions import seq
from cladeflow.functions import vectors as V
from cladeflow.operators import nj, pairing, representations, selection, taxonomy


def test_primers_and_windows(spark):
    p = seq.Primers("t", "GGWAC", "TTCC", 4, 2, 6)
    data = [(1, "AAGGTACACGTGGAATT"), (2, "GGAACNN"), (3, "CCGGAA"), (4, "ACGT"), (5, None), (6, "")]
    rows = seq.assess_window(spark.createDataFrame(data, "i int, s string"), "s", p)
    got = {r.i: r.metrics for r in rows.collect()}
    assert (got[1].primer_support, got[1].window_start, got[1].window_end, got[1].coverage_rank) == ("both", 7, 11, 0)
    assert (got[2].primer_support, got[2].ambiguity_fraction) == ("forward_only", 1.0)
    assert (got[3].primer_support, got[3].window_end, got[4].primer_support, got[5]) == ("reverse_only", 2, "none", None)
    assert got[6].ambiguity_fraction == 1.0
    fuzzy = seq.assess_window(spark.createDataFrame([(1, "TTGGTCCAA"), (2, "GGG"), (3, "GGTCCTTGGTACA"), (4, None)], "i int, s string"), "s", p, 1)
    got = {r.i: r.metrics and (r.metrics.primer_support, r.metrics.window_start, r.metrics.primer_mismatches) for r in fuzzy.collect()}
    assert got == {1: ("forward_only", 7, 1), 2: ("none", 0, 0), 3: ("forward_only", 12, 0), 4: None}


def test_reverse_complement_and_distance(spark):
    rows = spark.createDataFrame([("ACGTRN", "ACGTACGTAC", "ACATACGTNN")], "a string, b string, c string")
    r = rows.select(seq.reverse_complement(F.col("a")).alias("rc"), seq.site_counts(F.col("b"), F.col("c")).alias("n")).first()
    assert r.rc == "NYACGT" and (r.n.sites, r.n.ts, r.n.tv) == (8, 1, 0)


def test_pairs_of_large_groups_are_counted_without_rows(spark):
    # One group beyond the pair-by-pair way and longer than one product holds, and small ones; the plan has no join that makes rows of pairs.
    rng = np.random.default_rng(3)
    letters = np.array(list("ACGTN-é"))
    group = lambda i: "hot" if i < 700 else ["g1", "g2", "g3"][i % 3] if i < 760 else None
    data = [(group(i), i - 50, "".join(rng.choice(letters, 300 + i % 2 if i < 700 else i % 9))) for i in range(770)] + [("g1", None, "ACGT"), ("g1", 999, None)]
    rows = spark.createDataFrame(data, "g string, k bigint, s string").repartition(3)
    counted = seq.site_counts_within_groups(rows, "g", "k", "s", 5, 2)
    got = {}
    for r in counted.collect():
        got[r.g, r.sites, r.ts, r.tv] = got.get((r.g, r.sites, r.ts, r.tv), 0) + r.n
    pairs = pairing.within_groups(rows.where("s IS NOT NULL"), "g", "k", 5).select("g", seq.site_counts(F.col("s"), F.col("s_2")).alias("c"))
    want = {}
    for r in pairs.collect():
        want[r.g, r.c.sites, r.c.ts, r.c.tv] = want.get((r.g, r.c.sites, r.c.ts, r.c.tv), 0) + 1
    assert got == want and sum(want.values()) > 140 * 560 + 140 * 139 // 2
    assert "Join" not in counted._jdf.queryExecution().toString()


def test_neighbour_joining():
    edges, clamped = nj.neighbour_joining(np.array([[0, 1, 1], [1, 0, 3], [1, 3, 0.0]]))
    length = {c: w for _, c, w in edges}
    assert clamped == 1 and length[1] + length[2] == 3 and length[0] + length[1] == 1.5
    d = np.array([[0, 3, 8, 9], [3, 0, 9, 10], [8, 9, 0, 7], [9, 10, 7, 0.0]])
    edges, clamped = nj.neighbour_joining(d)
    up = {c: (p, w) for p, c, w in edges}

    def way(x):
        out = {x: 0.0}
        at, total = x, 0.0
        while at in up:
            at, total = up[at][0], total + up[at][1]
            out[at] = total
        return out

    for i in range(4):
        for j in range(i):
            a, b = way(i), way(j)
            assert abs(min(a[k] + b[k] for k in a.keys() & b.keys()) - d[i, j]) < 1e-9


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in rows.select(V.cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, None]
    angles = [0, 0.2, 0.4, 0.6, 0.9, 1.2, 1.25]
    circle = spark.createDataFrame([("g", i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)], "g string, id bigint, v array<double>")
    assert representations.cosine_medoids(circle, "g", "id", "v").first().id == 3
    ranks = spark.createDataFrame([(4,), (2,), (2,), (1,)], "v int").select("v", representations.average_rank(F.col("v")).alias("r")).collect()
    assert sorted((r.v, r.r) for r in ranks) == [(1, 1.0), (2, 2.5), (2, 2.5), (4, 4.0)]


def test_gates(spark):
    p = seq.Primers("t", "GGWAC", "TTCC", 4, 2, 6)
    columns = "record_no bigint, bin_uri string, marker_code string, phylum string, nuc string"
    good = "AAGGTACACGTGGAATT"
    data = [
        (1, "BOLD:AAA0001", "COI-5P", " arthropoda", good),
        (2, "BOLD:AAA0001", "COI-5P", "Arthropoda", good),
        (3, "n/a", "COI-5P", "Arthropoda", good),
        (4, "BOLD:AAA0002", "COI-5P", "Arthropoda", " - "),
        (5, "BOLD:AAA0002", "COI-5P", "Arthropoda", "123"),
        (6, "BOLD:AAA0002", "COI-5P", "Arthropoda", "ACG"),
        (7, "BOLD:AAA0002", "COI-5P", "Arthropoda", "NNNNGGTACACNNGGAATTNNNN"),
        (8, "BOLD:AAA0002", "COI-5P", "Arthropoda", "AAGGTACAGGAATT"),
        (9, "BOLD:AAA0002", "16S", "Arthropoda", good),
        (10, "BOLD:AAA0002", "COI-5P", "Mollusca", good),
        (11, "BOLD:AAA0003", "COI-5P", "Arthropoda", "NNNN" + good + "NNNN"),
    ]
    rows = spark.createDataFrame(data, columns)
    gates = selection.Gates(*selection.parse_taxon("Phylum:ARTHROPODA"), "COI-5P", 5, 0.1, selection.parse_crop("1:3"))
    got = {r.record_no: (r.drop_reason, r.output_sequence) for r in selection.assessed(rows, gates, p).collect()}
    reasons = dict(zip(range(3, 9), selection.REASONS))
    assert {k: v[0] for k, v in got.items()} == {1: None, 2: None, **reasons, 11: None}
    # Only the window's ambiguity counts, so the letters around it don't matter.
    assert got[1][1] == "CG" and got[11][1] == "CG"
    best = selection.representatives(rows, gates, p)
    assert sorted((r.bin_uri, r.record_no) for r in best.collect()) == [("BOLD:AAA0001", 1), ("BOLD:AAA0003", 11)]
    out = selection.representative_rows(rows, best, p).collect()
    assert [(r.record_no, r.nuc, r.selected_primer_set, r.selected_window_length) for r in out] == [(1, "CG", "t", 4), (11, "CG", "t", 4)]
    assert selection.child_rank("subspecies") is None and selection.child_rank("family") == "subfamily"


def test_placement(spark):
    data = [("t1", "F", "G", "G a")] * 2 + [("t1", "F", "G", "G b"), ("t2", "F", "G", None), ("t2", "F", "G", "G a"), ("t3", None, None, None)]
    data += [("t4", "F", "G", "G a"), ("t4", "H", "J", "J c"), ("t4", "H", "J", "J c")]
    rows = spark.createDataFrame(data, "t string, family string, genus string, species string")
    rows = rows.select("t", *[F.col(r) if r in rows.columns else F.lit(None).cast("string").alias(r) for r in taxonomy.RANKS])
    observed = taxonomy.observations(rows, F.col("t"))
    counts = observed.groupBy("path").agg(F.sum("n_records").alias("n_records"))
    chains = taxonomy.reconciled_chains(taxonomy.canonical_parents(taxonomy.parent_votes(counts)))
    candidates = taxonomy.terminal_candidates(observed)
    resolved = taxonomy.resolve_candidates(candidates, chains)
    placed = taxonomy.place_terminals(resolved, chains)
    assert {r.terminal: (r.placed_at, r.lifted, r.suspect) for r in placed.collect()} == {"t1": ("7:G", True, False), "t2": ("8:G a", False, False), "t4": (None, True, True)}
    by_votes = taxonomy.place_terminals(resolved, chains, "plurality")
    assert {r.terminal: r.placed_at for r in by_votes.collect()} == {"t1": "8:G a", "t2": "8:G a", "t4": "8:J c"}
    table = taxonomy.sidecar(candidates, placed)
    got = {r.terminal: r for r in table.collect()}
    assert (got["t4"].placed_at, got["t4"].lineages, got["t4"].counts, got["t4"].suspect) == ("root", "species:J c|species:G a", "2|1", "yes")
    notes = {r.terminal: r.annotation for r in taxonomy.annotation(taxonomy.sidecar(candidates, placed, style="gtdb")).collect()}
    assert notes["t4"] == "&rank=BIN,records=3,n_lineages=2,taxa={s__J_c,s__G_a},counts={2,1},placed_at=root,lifted=yes,suspect=yes"
    assert taxonomy.rank_path("tax_order", "species") == ("family", "subfamily", "tribe", "genus", "species")


def test_contract(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"p3_found", "p5_found", "p6_found"} <= names and set(entry.oracle_sql()) <= names
    assert entry.entry(spark).columns == ["field_name", "key_text"]
