"""Tree lengths, midpoints, text, comparison and vector shapes against known answers and brute force."""

import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.operators import nj, pairing, shapes, trees
from cladeflow.sources import readers, writers

ROWS = "tree string, node_id bigint, parent_id bigint, root_to_node_sum double, written_at timestamp_ntz, label string, length string"


def table(spark, data):
    return spark.createDataFrame([(*d, None, None, "clash") for d in data], ROWS)


def random_tree(seed, n):
    rng = random.Random(seed)
    ids = rng.sample(range(1000), n)
    total, rows = {ids[0]: 0.0}, [("t", ids[0], None, 0.0)]
    for i, node in enumerate(ids[1:], 1):
        up = ids[rng.randrange(max(0, i - 6), i)]
        total[node] = total[up] + rng.choice([0.0, 0.5, 1.25, 3.0])
        rows.append(("t", node, up, total[node]))
    return rows


def distances(edges):
    """All ways between nodes of (node, parent, length) edges."""
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []), near.setdefault(b, [])
        if b is not None:
            near[a].append((b, w)), near[b].append((a, w))
    out = {}
    for a in near:
        todo = [(a, None, 0.0)]
        while todo:
            x, came, d = todo.pop()
            out[a, x] = d
            todo += [(y, x, d + w) for y, w in near[x] if y != came]
    return out


def test_weights_and_unknown_lengths(spark):
    m = trees.Measured(table(spark, [("t", 0, None, 0.0), ("t", 1, 0, 1.0), ("t", 2, 0, 2.0), ("t", 3, 2, 3.0), ("t", 4, 2, 5.0)] * 2 + [("z", 7, None, None), ("z", 8, 7, None)]))
    got = {r.node_id: r.weight for r in trees.leaf_weights(m).collect()}
    assert {k: round(v * 7, 9) for k, v in got.items() if k != 8} == {1: 1, 3: 2, 4: 4} and got[8] == 1
    m = trees.Measured(table(spark, [("t", 0, None, 0.0), ("t", 1, 0, None), ("t", 2, 1, 2.0), ("t", 3, 2, 3.0), ("t", 4, 2, 5.0), ("t", 5, 0, 1.0)]))
    tips = {r.node_id: r.path for r in m.tips().collect()}
    pairs = spark.createDataFrame([("t", a, b, tips[a], tips[b]) for a, b in ((3, 4), (3, 5))], "tree string, a bigint, b bigint, path_a array<bigint>, path_b array<bigint>")
    assert {(r.a, r.b): (r.lca_id, r.steps, r.distance) for r in trees.patristic(pairs, m.nodes).collect()} == {(3, 4): (2, 2, 4.0), (3, 5): (0, 4, None)}


def test_midpoint_keeps_all_ways(spark):
    rows = random_tree(5, 40)
    m = trees.Measured(table(spark, rows))
    total = {n: s for _, n, _, s in rows}
    old = distances([(n, p, 0 if p is None else total[n] - total[p]) for _, n, p, _ in rows])
    tips = {n for _, n, _, _ in rows} - {p for _, _, p, _ in rows}
    longest = max(old[a, b] for a, b in itertools.combinations(tips, 2))
    assert abs(trees.midpoints(m).first().span - longest) < 1e-9
    new = trees.midpoint_rooted(m).collect()
    roots = [r.node_id for r in new if r.parent_id is None]
    ways = distances([(r.node_id, r.parent_id, r.length) for r in new])
    assert roots == [-1 - rows[0][1]] and len(new) == 41 and all(r.length >= 0 for r in new)
    assert all(abs(ways[k] - d) < 1e-9 for k, d in old.items())
    assert abs(max(ways[roots[0], t] for t in tips) - longest / 2) < 1e-9


def test_trees_of_nothing(spark):
    m = trees.Measured(table(spark, [("t", 1, 1, 0.0), ("t", 2, 9, 1.0), (None, 3, None, 0.0), ("t", None, None, 1.0)]))
    assert trees.leaf_weights(m).count() == trees.midpoints(m).count() == trees.midpoint_rooted(m).count() == 0


def test_newick_round_trip(spark, tmp_path):
    rows = random_tree(8, 30)
    m = trees.Measured(table(spark, rows))
    names = {n: f"it's {n}" if n % 3 else f"n{n}" for _, n, _, _ in rows if n % 5}
    labels = spark.createDataFrame([("t", n, x) for n, x in names.items()], "tree string, node_id bigint, label string")
    writers.write_newick(trees.newick_tokens(m.paths, m.edges, labels), str(tmp_path / "out"))
    back = list(readers.parse_newick("\n".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))))
    children = {}
    for _, n, p, _ in rows:
        children.setdefault(p, []).append(n)
    wanted = []

    def walk(n):
        wanted.append(names.get(n))
        for c in sorted(children.get(n, [])):
            walk(c)

    walk(rows[0][1])
    assert [b[2] for b in back] == wanted
    assert abs(sum(b[5] or 0 for b in back) - m.edges.agg(F.sum("length")).first()[0]) < 1e-6


def test_comparison(spark):
    # ((a,b),(c,d)) against ((a,c),(b,d)): vectors of common ancestors [1,0,0,0,0,1] and [0,1,0,0,1,0].
    one = {"a": "x", "b": "x", "c": "y", "d": "y"}
    two = {"a": "x", "c": "x", "b": "y", "d": "y"}
    data = [("r", s, k, ["root", v, k]) for s, t in (("1", one), ("2", two)) for k, v in t.items()] + [("r", "1", "only", ["root", "only"])]
    data += [("same", s, k, ["root", v, k]) for s in "12" for k, v in one.items()]
    tips = spark.createDataFrame(data, "run string, side string, label string, path array<string>")
    got = {r.run: r for r in trees.compare_sides(trees.clade_lists(tips), "1", "2").collect()}
    assert (got["r"].n_shared, got["r"].rf, got["r"].kc, got["r"].kc_normalised) == (4, 4, 2.0, round(1 / 6**0.5, 6))
    assert (got["same"].rf, got["same"].kc, got["same"].rf_normalised) == (0, 0.0, 0.0)


def test_shapes(spark):
    assert abs(shapes.wasserstein(np.array([1.0]), np.array([[2.0]]), np.array([4.0]), np.array([[5.0]])) - 18**0.5) < 1e-12
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)) + np.array([3.0, 1.0, 0.0, -1.0])
    data = [("ab"[i % 3 == 0], x[i].tolist()) for i in range(60)] + [(None, [1.0] * 4), ("a", [0.0] * 4), ("a", None), ("a", [1.0])]
    rows = spark.createDataFrame(data, "g string, v array<double>")
    cells = shapes.moment_cells(rows, "g", "v", 4)
    a = x[[i for i in range(60) if i % 3]]
    cov = np.cov(a.T)
    assert all(abs(r.cov - cov[r.i, r.j]) < 1e-9 and r.n == 40 for r in shapes.covariances(cells).where("grp = 'a'").collect())
    parents = spark.createDataFrame([("a", "all"), ("b", "all")], "grp string, parent string")
    got = {r.grp: r.distance for r in shapes.gaussian_distances(cells, parents, 4).collect()}
    want = shapes.wasserstein(a.mean(axis=0), np.linalg.cholesky(cov), x.mean(axis=0), np.linalg.cholesky(np.cov(x.T)))
    assert abs(got["a"] - want) < 1e-6
    mean = {r.g: np.array(r["mean"]) for r in shapes.spherical_means(rows, "g", "v", 4).collect()}["a"]
    u = a / np.linalg.norm(a, axis=1, keepdims=True)
    cost = lambda m: (np.arccos(np.clip(u @ (m / np.linalg.norm(m)), -1, 1)) ** 2).sum()
    assert abs(np.linalg.norm(mean) - 1) < 1e-9
    assert all(cost(mean) <= cost(mean + 1e-3 * d) for d in rng.normal(size=(50, 4)))


def test_middle_of_a_connector():
    edges = [(4, 0, 1.0), (4, 1, 2.0), (5, 2, 6.0), (5, 3, 1.0), (5, 4, 1.0)]
    rooted = nj.rooted_in_middle(4, edges)
    up = {c: (p, w) for p, c, w in rooted}
    depth = {}
    for t in range(4):
        at, total = t, 0.0
        while at != -1:
            total, at = total + up[at][1], up[at][0]
        depth[t] = total
    assert depth == {0: 3.5, 1: 4.5, 2: 4.5, 3: 2.5} and len(rooted) == 6
    assert {p for p, _, _ in nj.rooted_in_middle(3, [(3, 0, 0.0), (3, 1, 0.0), (3, 2, 0.0)])} == {-1}


def specimens(spark):
    rng = random.Random(2)
    data = [(f"r{o}{f}{s}{k}", f"o{o}", f"f{f}", f"s{s}", [o * 9.0 + rng.random(), f * 3.0 + rng.random(), s + rng.random(), 1.0]) for o in range(2) for f in range(o + 1) for s in range(4) for k in range(1 + s)]
    data += [("x", None, "f", "s", [1.0] * 4), ("y", "o1", "f0", "s0", [0.0] * 4), (None, "o1", "f0", "s0", [1.0] * 4)]
    return spark.createDataFrame(data, "id string, o string, f string, s string, v array<double>"), {d[0] for d in data[:-3]}


def test_taxon_trees_by_every_method(spark):
    rows, tips = specimens(spark)
    for method in nj.METHODS:
        edges = nj.taxon_tree(rows, "id", ["o", "f", "s"], "v", 4, method).collect()
        up = {e.child: e.parent for e in edges}
        assert len(up) == len(edges) and set(up.values()) - set(up) == {"root"}
        assert set(up) - set(up.values()) == tips and all(e.length >= 0 and e.clamped >= 0 for e in edges)
    parts = nj.taxon_tree(rows, "id", ["o"], "v", 4, "centroid", max_children=6).collect()
    up = {e.child: e.parent for e in parts}
    assert set(up) - set(up.values()) == tips and set(up.values()) - set(up) == {"root"} and any("#p" in c for c in up)
    fan = [sum(c in tips for c in up if up[c].split("#")[0] == p) for p in set(up.values())]
    assert max(fan, default=0) <= len(tips)


def test_weights_follow_the_tree_below(spark):
    # Weights of the tips of (a:1,(b:1,c:3):2) are 1, 2 and 4 sevenths.
    edges = spark.createDataFrame([("t", "t", "a", 1.0, 0, 1.0), ("t", "t", "bc", 2.0, 0, 1.0)], nj.EDGES)
    low = spark.createDataFrame([("bc", "bc", "b", 1.0, 0, 1.0), ("bc", "bc", "c", 3.0, 0, 3.0)], nj.EDGES)
    one = lambda name, taxon, v: (taxon, name, 1, v, v, [0.0] * 3, 0.0)
    columns = "taxon string, child string, n bigint, mean array<double>, total array<double>, shared array<double>, share_sum double"
    unit = {"a": [1.0, 0.0, 0.0], "b": [0.0, 1.0, 0.0], "c": [0.0, 0.0, 1.0]}
    bc = nj._summed(spark.createDataFrame([one("b", "bc", unit["b"]), one("c", "bc", unit["c"])], columns), low, "midpoint", 3)
    up = nj._summed(bc.withColumn("taxon", F.lit("t")).select(*[c.split()[0] for c in columns.split(", ")]).unionByName(spark.createDataFrame([one("a", "t", unit["a"])], columns)), edges, "midpoint", 3).first()
    assert [round(7 * x / up.share_sum, 9) for x in up.shared] == [1, 2, 4] and up.n == 3 and up["mean"] == [1 / 3] * 3


def test_plain_trees_and_clusters(spark):
    rows, tips = specimens(spark)
    two = spark.createDataFrame([("p", "g", [1.0, 0.0]), ("q", "g", [1.0, 1e-9])], "id string, g string, v array<double>")
    assert sorted((e.child, e.length) for e in nj.taxon_tree(two, "id", ["g"], "v", 2, style="plain").collect() if e.rank == "record") == [("p", 0.001), ("q", 0.001)]
    numbered = rows.where("id IS NOT NULL AND v[3] = 1").withColumn("n", F.xxhash64("id"))
    labels, means = nj.spherical_kmeans(numbered, "n", "v", 4, 5)
    given, centers = {r.n: r.cluster for r in labels.collect()}, {r.cluster: np.array(r["mean"]) for r in means.collect()}
    for r in numbered.collect():
        sims = {c: float(np.dot(m, r.v) / np.linalg.norm(r.v)) for c, m in centers.items()}
        assert sims[given[r.n]] >= max(sims.values()) - 1e-6
    tree = nj.unsupervised_tree(numbered.select("n", "v"), "n", "v", 4, 5).collect()
    up = {e.child: e.parent for e in tree}
    assert len(set(up) - set(up.values())) == numbered.count()
    m = nj.measured(nj.as_nodes(nj.taxon_tree(rows, "id", ["o", "f"], "v", 4), "t"))
    assert m.leaves().count() == len(tips)


def test_pruning_splits_and_rooting(spark):
    #        0
    #      1   2      lengths 1, 2; tips 3..6 below, 7 below 6 alone
    rows = [("t", 0, None, 0.0), ("t", 1, 0, 1.0), ("t", 2, 0, 2.0), ("t", 3, 1, 2.0), ("t", 4, 1, 3.0), ("t", 5, 2, 4.0), ("t", 6, 2, 5.0), ("t", 7, 6, 6.5)]
    m = trees.Measured(table(spark, rows))
    kept = trees.pruned(m.tips().where("node_id != 5"), m.nodes, ["tree"]).collect()
    assert {(r.node_id, r.parent_id, r.span, r.length) for r in kept} == {(0, None, None, None), (1, 0, 1, 1.0), (3, 1, 1, 1.0), (4, 1, 1, 2.0), (7, 0, 3, 6.5)}
    order = {r.node_id: (r.preorder, r.first_tip, r.last_tip) for r in trees.preorder(m).collect()}
    assert order == {0: (0, 0, 3), 1: (1, 0, 1), 3: (2, 0, 0), 4: (3, 1, 1), 2: (4, 2, 3), 5: (5, 2, 2), 6: (6, 3, 3), 7: (7, 3, 3)}
    named = m.tips().select("tree", F.lit("a").alias("side"), F.concat(F.lit("n"), "node_id").alias("label"), "path", "distance")
    turned = trees.outgroup_rooted(m, spark.createDataFrame([("t", 3)], "tree string, node_id bigint"))
    again = trees.Measured(turned.select("tree", "node_id", "parent_id"), turned.select("tree", "node_id", "parent_id", "length"))
    other = again.tips().select("tree", F.lit("b").alias("side"), F.concat(F.lit("n"), "node_id").alias("label"), "path", "distance")
    both = named.unionByName(other)
    rooted = trees.split_distance(trees.clade_splits(both, ["tree", "side"]), "tree", "side", "a", "b").first()
    unrooted = trees.split_distance(trees.clade_splits(both, ["tree", "side"], rooted=False), "tree", "side", "a", "b").first()
    assert (rooted.rf, rooted.n_first, rooted.n_second) == (2, 2, 2) and (unrooted.rf, unrooted.n_first) == (0, 1)
    rho = trees.depth_correlation(named.unionByName(other.withColumn("distance", -F.col("distance"))), "tree", "side", "a", "b").first()
    assert rho.n_shared == 4 and rho.status == "ok"
    ids = {r.split_id for r in trees.split_ids(named, ["tree"]).collect()}
    assert ids == {hashlib.sha256(json.dumps(x, separators=(",", ":")).encode()).hexdigest()[:20] for x in (["n3", "n4"], ["n5", "n7"])}
    tops = spark.createDataFrame([("t", 2)], "tree string, node_id bigint")
    assert {(r.node_id, r.parent_id, r.length) for r in trees.clade_nodes(m, tops).collect()} == {(2, None, 0.0), (5, 2, 2.0), (6, 2, 3.0), (7, 6, 1.5)}
    marked = spark.createDataFrame([("t", 0, "Root"), ("t", 2, "Two")], "tree string, node_id bigint, label string")
    assert {r.node_id: r.label for r in trees.nearest_marked(m.paths, marked).collect()}[7] == "Two"
    levels = trees.fork_pairs(m.tips())
    assert {(r.lca_id, r.level) for r in levels.collect()} == {(0, 0), (1, 1), (2, 1)}
    lengths = spark.createDataFrame([(0.0,), (1.5,), (0.02,), (1.25e-7,), (123456.789,), (1 / 3,)], "x double").select(trees.length_text(F.col("x")).alias("t"))
    assert [r.t for r in lengths.collect()] == ["0", "1.5", "0.02", "1.25e-07", "123456.789", "0.333333333333"]


def test_pairs(spark):
    rows = spark.createDataFrame([("g", i) for i in range(30)] + [("h", 99), (None, 7)], "g string, k bigint")
    inside = {(r.k, r.k_2) for r in pairing.within_groups(rows, "g", "k", 5).collect()}
    assert len(inside) == len({frozenset(p) for p in inside}) == sum(1 for a in range(30) for b in range(a) if a % 5 == 0 or b % 5 == 0)
    every = {(r.k, r.k_2) for r in pairing.all_within_groups(rows, "g", "k", 435).collect()}
    assert every == {(a, b) for a in range(30) for b in range(a + 1, 30)}
    with pytest.raises(ValueError):
        pairing.all_within_groups(rows, "g", "k", 434)
    some = {(r.k, r.k_2) for r in pairing.sampled_pairs(rows.where("g = 'g'"), "k", 100).collect()}
    again = {(r.k, r.k_2) for r in pairing.sampled_pairs(rows.where("g = 'g'").repartition(5), "k", 100).collect()}
    assert some == again and len(some) == 100 and all(a < b for a, b in some)
    assert {(r.k, r.k_2) for r in pairing.sampled_pairs(rows.where("g = 'g'"), "k", 1000).collect()} == every
    drawn = {r.k: r.k_2 for r in pairing.partners(rows, "g", "k").collect()}
    assert set(drawn) == set(range(30)) and all(a != b for a, b in drawn.items())
    leveled = spark.createDataFrame([(0, i) for i in range(3)] + [(1, i) for i in range(50)] + [(2, i) for i in range(50)], "level int, i int")
    got = pairing.by_level(leveled, "level", 24, F.col("i")).groupBy("level").count().collect()
    assert {r.level: r["count"] for r in got} == {0: 3, 1: 11, 2: 10}
