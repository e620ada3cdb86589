"""Hot keys, hierarchies and failing rows against brute force on small fixtures."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cladeflow.functions.text import bin_name, blank_clean, taxon_name
from cladeflow.operators import hierarchy, hotkeys, rejects

NODES = "tree string, node_id bigint, parent_id bigint"


def test_cleaning(spark):
    rows = spark.createDataFrame([("　 a  b ",), ("N/A",), (" - ",), ("",), (None,)], "v string")
    assert [r[0] for r in rows.select(blank_clean(F.col("v"))).collect()] == ["a b", None, None, None, None]
    names = spark.createDataFrame([("\tABIES ",), ("unknown",), ("pinus",)], "v string")
    assert [r[0] for r in names.select(taxon_name(F.col("v"))).collect()] == ["Abies", None, "Pinus"]
    bins = ["bold: abc-0123", "ABC0123", "BOLD:ABC012", "BOLD:ABCD0123", "BOLD：ABC0123;", None, ""]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in bins], "v string").select(bin_name(F.col("v"))).collect()]
    assert got == ["BOLD:ABC0123", "BOLD:ABC0123", None, None, "BOLD:ABC0123", None, None]


def test_quantiles_of_a_hot_key(spark):
    rng = random.Random(4)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(6)}", rng.choice([None, rng.randrange(-5000, 5000)]), "x") for _ in range(3000)]
    data += [(None, 5, "x"), ("empty", None, "x")]
    rows = spark.createDataFrame(data, "k string, v bigint, value string")
    for bins, limit in ((16, 10**6), (16, 0), (100_000, 10**6)):
        got = {r.key_text: r for r in hotkeys.key_quantiles(rows, {"k": F.col("k")}, F.col("v"), (0.0, 0.5, 0.9), bins, limit).collect()}
        by = defaultdict(list)
        for k, v, _ in data:
            if k is not None:
                by[k].append(v)
        assert set(got) == set(by)
        for k, vs in by.items():
            known = sorted(v for v in vs if v is not None)
            assert got[k].n_rows == len(vs) and got[k].n_values == len(known)
            for p, name in ((0.0, "q00"), (0.5, "q50"), (0.9, "q90")):
                assert got[k][name] == (known[max(1, math.ceil(p * len(known))) - 1] if known else None)


def test_quantiles_of_a_hot_value(spark):
    rows = spark.createDataFrame([("hot", 7)] * 900 + [("hot", i * 1000) for i in range(100)] + [("cold", 5)], "k string, v bigint")
    got = {r.key_text: (r.q10, r.q95) for r in hotkeys.key_quantiles(rows, {"k": F.col("k")}, F.col("v"), (0.1, 0.95), 16, 0).collect()}
    assert got == {"hot": (7, 49_000), "cold": (5, 5)}


def test_quantiles_of_nothing(spark):
    rows = spark.createDataFrame([], "k string, v bigint")
    assert hotkeys.key_quantiles(rows, {"k": F.col("k")}, F.col("v")).count() == 0


def fates(nodes):
    parent = {(t, n): p for t, n, p in nodes}
    out = {}
    for t, n in parent:
        seen, at = [n], n
        while True:
            up = parent[t, at]
            if up is None:
                out[t, n] = ("rooted", at, len(seen) - 1, seen[::-1])
            elif (t, up) not in parent:
                out[t, n] = ("lost", None, None, None)
            elif up in seen:
                out[t, n] = ("cycle" if up == n else "below_cycle", None, None, None)
            else:
                seen.append(up)
                at = up
                continue
            break
    return out


def random_forest(seed, n=400):
    rng = random.Random(seed)
    nodes = []
    for t in ("a", "b"):
        for i in range(n):
            r = rng.random()
            up = None if i == 0 or r < 0.01 else (i - 1 if r < 0.5 else rng.randrange(i)) if r < 0.95 else rng.randrange(n + 20)
            nodes.append((t, i, up))
    return nodes


def test_hierarchies_against_walking(spark):
    for seed, every in ((1, 8), (2, 3), (3, 10**6), (4, 1)):
        nodes = random_forest(seed)
        rows = spark.createDataFrame(nodes + nodes[:50] + [(None, 1, 2), ("a", None, 2)], NODES).withColumn("fate", F.lit("clash"))
        expected = fates(nodes)
        got = {(r.tree, r.node_id): (r.fate, r.root_id, r.depth) for r in hierarchy.hierarchy_status(rows, every).collect()}
        assert got == {k: v[:3] for k, v in expected.items()}
    paths = hierarchy.hierarchy_paths(rows)
    assert {(r.tree, r.node_id): r.path for r in paths.collect()} == {k: v[3] for k, v in expected.items() if v[0] == "rooted"}
    below = Counter((r.tree, r.ancestor_id) for r in hierarchy.descendants(paths).collect())
    assert below == Counter((k[0], x) for k, v in expected.items() if v[0] == "rooted" for x in v[3][:-1])


def test_small_cycles(spark):
    nodes = [("t", 1, 1), ("t", 2, 3), ("t", 3, 2), ("t", 4, 2), ("t", 5, 9), ("t", 6, None), ("u", 1, None)]
    got = {(r.tree, r.node_id): r.fault for r in hierarchy.hierarchy_faults(spark.createDataFrame(nodes, NODES)).collect()}
    assert got == {("t", 1): "cycle", ("t", 2): "cycle", ("t", 3): "cycle", ("t", 4): "below_cycle", ("t", 5): "lost"}
    assert hierarchy.hierarchy_faults(spark.createDataFrame([], NODES)).count() == 0


def test_failing_lines(spark):
    good = ["p", "BOLD:abc0123", *["x"] * 9, "Abies alba", "ACGT", "c", "n"]

    def line(**cells):
        names = list(rejects.DUMP_COLUMNS)
        return "\t".join(cells.get(n, good[i]) for i, n in enumerate(names))

    lines = {
        1: (line() + "\r", None),
        2: (line(notes='"tab\there ""quoted"" end"'), None),
        3: (line(notes='"open'), "quoting"),
        4: (line(notes='"shut" more'), "quoting"),
        5: (line() + "\textra", "columns"),
        6: ("", "columns"),
        7: (None, "columns"),
        8: (line(bin_uri="BOLD:AB0123"), "value"),
        9: (line(bin_uri=" n/a ", species="-"), None),
        10: (line(species="abies alba"), "value"),
        11: (line(species="Abies"), "value"),
        12: (line(species='"Abies cf. alba"', notes='so "called" form'), None),
        13: (line(notes='""'), None),
        14: (line(notes='"""'), "quoting"),
        15: (line(notes='"a\u0000""b"'), None),
        16: ('"' + 'x""' * 20000, "quoting"),
    }
    rows = spark.createDataFrame([(k, "f", v[0], "clash") for k, v in lines.items()], "line_no bigint, source_file string, raw_line string, species string")
    parsed = rejects.parse_lines(rows)
    assert {r.line_no: r.reason for r in rejects.failed_rows(parsed).collect()} == {k: v[1] for k, v in lines.items() if v[1]}
    errors = {r.line_no: [tuple(e) for e in r.errors] for r in rejects.failed_rows(parsed).collect()}
    assert errors[3] == [("quoting", None)] and errors[14] == [("quoting", None)] and errors[16] == [("quoting", None), ("columns", None)]
    both = spark.createDataFrame([(1, "f", line(bin_uri="x", species="y")), (2, "f", line(nuc="12"))], "line_no bigint, source_file string, raw_line string")
    assert [tuple(e) for e in rejects.failed_rows(rejects.parse_lines(both)).first().errors] == [("value", "bin_uri"), ("value", "species")]
    typed = rejects.parse_lines(both, rules=[rejects.Rule("nuc", cast="int")])
    assert [r.line_no for r in rejects.sound_rows(typed).collect()] == [2]
    plan = rejects.failed_rows(parsed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("aggregate(") <= 1
    sound = {r.line_no: r for r in rejects.sound_rows(parsed).collect()}
    assert sound[2].notes == 'tab here "quoted" end' and sound[9].bin_uri is None and sound[15].notes == 'a\u0000"b'
