"""Operators on training data against brute force, libraries and planted cases."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from cladeflow.llm import clusters, leaks, pii, sampling, survivors, tokenizer
from cladeflow.session import Scratch

RECORDS = "record_no bigint, bin_uri string, ingested_at timestamp, " + ", ".join(f"{r} string" for r in survivors.RANKS)
SCORES = "record_no bigint, primer_support string, coverage_rank int, primer_mismatches int, ambiguity_fraction double, scored_at timestamp"


def test_survivors(spark):
    t = datetime(2024, 1, 1)
    blank = [None] * len(survivors.RANKS)
    genus = survivors.RANKS.index("genus")

    def rec(n, b, g):
        return (n, b, t, *[g if i == genus else x for i, x in enumerate(blank)])

    records = spark.createDataFrame([rec(1, "bold:abc0123", "abies"), rec(2, "ABC0123", "Abies "), rec(3, "ABC0123", "Picea"), rec(4, "XYZ0001", None), rec(5, None, "Abies")], RECORDS)
    day = timedelta(days=1)
    scores = spark.createDataFrame(
        [
            (1, "both", 0, 1, 0.0, t),
            (1, "both", 2, None, float("nan"), t + day),
            (2, "none", 2, 1, 0.1, t),
            (2, "none", 2, 1, 0.1, t),
            (3, "both", 9, 0, 0.0, t),
            (9, "both", 0, 0, 0.0, t),
        ],
        SCORES,
    )
    assert [tuple(r) for r in survivors.best_records(records, scores).collect()] == [("BOLD:ABC0123", 1)]
    whole = survivors.survivors(records, scores).first()
    assert (whole.genus, whole.n_rows, whole.coverage_rank, whole.ambiguity_fraction, whole.family) == ("Abies", 3, 2.0, 0.0, None)
    assert survivors.best_records(records, scores.limit(0)).first().record_no == 1
    assert survivors.best_records(records.limit(0), scores).count() == 0


def vectors(seed, groups):
    rng = np.random.default_rng(seed)
    rows, truth, i = [], {}, 0
    for size in groups:
        base = rng.standard_normal(64)
        ids = []
        for _ in range(size):
            v = base + 0.02 * rng.standard_normal(64) * np.linalg.norm(base)
            rows.append((i * 7 + 3, [float(x) for x in v * rng.uniform(0.1, 9)]))
            ids.append(i * 7 + 3)
            i += 1
        truth |= dict.fromkeys(ids, min(ids))
    return rows, truth


@pytest.mark.parametrize("block", [8192, 40])
def test_clusters(spark, block):
    rows, truth = vectors(5, [120, 40, 1, 2, 3, 2, 1] + [2] * 30)
    dirty = [(1, None), (2, []), (4, [0.0] * 64), (5, [float("nan")] * 64), (6, [1.0] * 63), (None, [1.0] * 64)]
    shuffled = rows + dirty
    random.Random(1).shuffle(shuffled)
    frame = spark.createDataFrame(shuffled, "faiss_id bigint, embedding array<float>")
    got = {r.id: r.cluster_id for r in clusters.cluster(frame, block=block).collect()}
    assert got == truth
    assert clusters.grouped(clusters.cluster(frame.limit(0))).count() == 0


def test_sample_is_stable(spark):
    rng = random.Random(2)
    data = [(rng.choice([f" id{i % 700}", f"ID{i % 700} ", None if i % 50 == 0 else f"Id{i % 700}"]), 1 + i * 3 // 1500, i, "x") for i in range(1500)]
    frame = spark.createDataFrame(data, "ids string, bundle_no int, faiss_id bigint, id string")
    once = sampling.number(sampling.arrivals(frame))
    seqs = {r.id: r.seq_no for r in once.collect()}
    assert sorted(seqs.values()) == list(range(len(seqs)))
    early = sampling.number(sampling.arrivals(frame.where("bundle_no = 1")))
    grown = sampling.number(sampling.arrivals(frame), early)
    assert {r.id: r.seq_no for r in grown.collect()} == seqs
    small = {r.id for r in sampling.block_sample(early, 50, 5).collect()}
    large = {r.id for r in sampling.block_sample(once.repartition(7), 50, 5).collect()}
    assert small and small <= large and large == {r.id for r in sampling.block_sample(grown, 50, 5).collect()}
    assert {r.id: r.seq_no for r in sampling.delivered(frame).collect()} == seqs
    assert sampling.block_sample(sampling.number(sampling.arrivals(frame.limit(0)))).count() == 0
    assert sampling.delivered(frame.limit(0)).count() == 0


def test_numbers_follow_the_registry(spark):
    rows = "ids string, bundle_no int, faiss_id bigint"
    one = sampling.number(sampling.arrivals(spark.createDataFrame([("x", 1, 5)], rows)))
    more = spark.createDataFrame([("x", 1, 5), ("z", 2, 6), ("y", 1, -(2**62)), ("late", None, 1), ("w", 2, 2**62), ("v", 2, None)], rows)
    assert {r.id: r.seq_no for r in sampling.number(sampling.arrivals(more), one).collect()} == {"X": 0, "Y": 1, "Z": 2, "W": 3, "V": 4, "LATE": 5}
    assert {r.id: r.seq_no for r in sampling.delivered(more).collect()} == {"Y": 0, "X": 1, "Z": 2, "W": 3, "V": 4, "LATE": 5}
    hashed = [(f"h{i}", 1, (i * 0x9E3779B97F4A7C15 + 7) % 2**64 - 2**63) for i in range(500)]
    got = {r.id: r.seq_no for r in sampling.number(sampling.arrivals(spark.createDataFrame(hashed, rows).repartition(6))).collect()}
    assert got == {h[0].upper(): i for i, h in enumerate(sorted(hashed, key=lambda h: h[2]))}


def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(tokenizer.VOCABULARY.replace(".tiktoken", ".json"))
    reference.encode_special_tokens = True
    rng = random.Random(3)
    signs = "  \t\n\r\x0b\x1c\x85\xa0　'''stmdrevl12²Ⅷ٣aZéß漢🧬é<|endoftext|>._-\"​"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(400)] + ["", " ", "x" * 20000, "don't we'll 'tis <|endoftext|>", None]
    frame = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in tokenizer.encode_column(frame).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (reference.encode(t, add_special_tokens=False).ids if t else [])
    back = {r.doc_id: r.decoded for r in tokenizer.decode_column(tokenizer.encode_column(frame)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    tiny = tokenizer.Encoder(tokenizer.serialise_model(tokenizer.read_ranks(tokenizer.VOCABULARY)), cache_entries=5)
    assert all(np.frombuffer(tiny.encode(t), np.int32).tolist() == got[i] for i, t in enumerate(texts[:50]))


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.choice([5, 13, 20, 40])))) for k in range(25)] + [(90, None), (91, "")]
    docs = []
    for d in range(80):
        body = [rng.choice(pool) for _ in range(rng.randrange(60))]
        source = rng.choice(items[:25])[1].split()
        n = rng.randrange(8, 20)
        a = rng.randrange(len(source))
        body[5:5] = source[a : a + n]
        sep = rng.choice([" ", "\\n> ", "<br/>", "&quot; ", "**, ", "\n# "])
        docs.append((d, sep.join(body), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (502, docs[0][1], "x")]
    got = {
        (r.doc_id, r.item_id)
        for r in leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items + items[:2], "item_id bigint, item_text string")).collect()
    }
    grams = {}
    for k, t in items:
        w = leaks.words(t)
        for i in range(len(w) - 12):
            grams.setdefault(tuple(w[i : i + 13]), set()).add(k)
    expected = set()
    for d, t, _ in docs:
        w = leaks.words(t)
        for i in range(len(w) - 12):
            expected |= {(d, k) for k in grams.get(tuple(w[i : i + 13]), ())}
    assert expected and got == expected


def edits(pattern, text):
    """Fewest edits between a pattern and any stretch of a text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        following = [i + 1]
        for j, t in enumerate(text):
            following.append(min(row[j] + (p != t), row[j + 1] + 1, following[j] + 1))
        row = following
    return min(row)


def test_near_leaks_against_brute_force(spark):
    rng = random.Random(12)
    pool = [f"w{i}" for i in range(40)]
    items = [(k, [rng.choice(pool) for _ in range(rng.choice([12, 13, 18]))]) for k in range(12)]
    docs = []
    for d in range(90):
        part = list(rng.choice(items)[1])
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(part))
            part[at : at + rng.randrange(2)] = [rng.choice(pool)] * rng.randrange(2)
        docs.append((d, [rng.choice(pool) for _ in range(rng.randrange(4))] + part + [rng.choice(pool) for _ in range(rng.randrange(4))]))
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string")
    asked = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, item_text string")
    for most in (0, 1, 2):
        expected = {}
        for d, text in docs:
            for k, item in items:
                fewest = min((edits(item[i : i + 13], text) for i in range(len(item) - 12)), default=99)
                if fewest <= most:
                    expected[d, k] = 13 - fewest
        got = {(r.doc_id, r.item_id): r.matched for r in leaks.leaks(frame, asked, most, block=5).collect()}
        assert expected and got == expected


def test_index_holds_every_posting(spark):
    texts = ["a b a", "b <b " + "x" * 500 + ">c", None, "", "a"]
    rows = leaks.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)).collect()
    got = {}
    for r in rows:
        at = 0
        for d, n in zip(r.docs, r.counts):
            got.setdefault((r.term, d), []).extend(r.positions[at : at + n])
            at += n
    assert got == {("a", 0): [0, 2], ("b", 0): [1], ("b", 1): [0], ("c", 1): [1], ("a", 4): [0]}


def test_words_of_markup():
    text = 'x\\n"A <b>bold</b>&lt;5 \\u00e9t\\u00e9" \x1b[0;31mred\x1b[0m **em**phasis [link](http://a.b/c)'
    assert leaks.words(text) == ["x", "a", "bold", "5", "été", "red", "em", "phasis", "link"]


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("mail mailto:ana.b+x@lab-site.example now", "email", "ana.b+x@lab-site.example"),
        ("user=bo [at] mail [dot] site [dot] test phone=07700 900123", "email", "bo [at] mail [dot] site [dot] test"),
        ("user=x phone=0044 (0)1632 960123\n", "phone", "0044 (0)1632 960123"),
        ("call +33 1 99 00 12 34", "phone", "+33 1 99 00 12 34"),
        ("(tel. (212) 555-0123).", "phone", "(212) 555-0123"),
        ("passport no. X12345678", "id_number", "X12345678"),
        ("7;Ana Bo;912-34-5678\\n8", "id_number", "912-34-5678"),
        ("NI number QQ 12 34 56 C", "id_number", "QQ 12 34 56 C"),
        ("stored at Flat 3, 12 Old Mill Rd\nTown", "address", "Flat 3, 12 Old Mill Rd"),
        ("at 14 rue des Lilas, 75000", "address", "14 rue des Lilas"),
        ("| Calle Mayor 5, 2º B |", "address", "Calle Mayor 5"),
        ("in Lindenallee 7, 10000", "address", "Lindenallee 7"),
        ("Thanks to Dr. Elena Novakova for it", "person_name", "Elena Novakova"),
        ("\\nCollector Smithers, Bo, 12", "person_name", "Smithers, Bo"),
        ("# reviewed by E. O'Hara, call", "person_name", "E. O'Hara"),
    ],
)
def test_details(text, kind, value):
    found = [(k, text[s:e]) for k, s, e in pii.find_details(text)]
    assert (kind, value) in found
    assert f"[{kind.upper()}]" in pii.redact(text)


def test_no_details(spark):
    for text in (None, "", "params@grid.shape pkg@1.14.2 a@b.T", "serial = '0415-5550-172'", "see Table 12 Road network", "Random Forest and Monte Carlo runs", "2023-04-17 09:12:55.0123", "52.5244201, -4.4777326", "Homo sapiens"):
        assert pii.find_details(text) == []
    frame = spark.createDataFrame([(1, None, "x"), (2, "mail a.b@c.example", "x")], "doc_id bigint, text string, pii_type string")
    assert [tuple(r) for r in pii.details(frame).collect()] == [(2, "email", 5, 18)]
    assert {r.doc_id: r.text for r in pii.redacted(frame).collect()} == {1: None, 2: "mail [EMAIL]"}


def test_checksums():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("1234567" + f"{97 - 1234567 % 97:02d}")


def test_descent_finds_neighbours_by_itself(spark):
    # No block contracts, and the table is far larger than a bucket.
    rng = np.random.default_rng(11)
    base = np.repeat(rng.standard_normal((150, 64)), 20, axis=0)
    x = base + 0.25 * rng.standard_normal(base.shape)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "faiss_id bigint, embedding array<float>").repartition(5)
    nodes = clusters.contract_blocks(frame, "faiss_id", "embedding", clusters.THRESHOLD, 1)
    lists = clusters.neighbour_descent(nodes, Scratch(spark, "descent"), bucket=128)
    got = {}
    for r in lists.collect():
        got.setdefault(r.src, set()).add(r.dst)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = wanted = 0
    for q in range(0, len(x), 20):
        sims = unit @ unit[q]
        sims[q] = -1
        near = np.argsort(-sims)[: clusters.NEIGHBOURS]
        near = near[sims[near] >= clusters.THRESHOLD]
        found, wanted = found + len(got.get(q, set()) & set(near.tolist())), wanted + len(near)
    assert wanted > 500 and found / wanted >= 0.9


def test_clusters_do_not_depend_on_the_layout(spark):
    rows, truth = vectors(9, [250, 60, 20, 5] + [3] * 40)
    frame = spark.createDataFrame([(i, e, "Abies alba") for i, e in rows], "faiss_id bigint, embedding array<float>, species string")
    runs = []
    for parts in (1, 4, 7):
        laid = frame.repartition(parts)
        found = clusters.cluster(laid, block=50)
        assert {r.id: r.cluster_id for r in found.collect()} == truth
        runs.append(sorted((r.cluster_id, tuple(r.typical_ids), r.n_members) for r in clusters.describe(found, laid).collect()))
    assert runs[0] == runs[1] == runs[2]


def test_communities_by_modularity(spark):
    # Two tight groups joined by one link stay apart at resolution 1 and are one component at 0.
    links = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 6) for b in range(a + 1, g + 6)] + [(5, 10, 0.9)]
    frame = spark.createDataFrame(links, "a bigint, b bigint, w double")
    sets = lambda r: {r_.id: r_.label for r_ in clusters.communities(frame, Scratch(spark, "c"), r).collect()}
    assert sets(1.0) == {**dict.fromkeys(range(6), 0), **dict.fromkeys(range(10, 16), 10)}
    assert set(sets(0.0).values()) == {0}


def test_bucketings_keep_the_bound():
    agree = 1 - np.arccos(clusters.THRESHOLD) / np.pi
    for n in (1, 1_000, 15_000, 150_000, 2_000_000, 10**9):
        bits, tables = clusters.bucketings(n, clusters.THRESHOLD)
        assert (1 - agree**bits) ** tables <= clusters.MISS
    assert clusters.bucketings(1_000, clusters.THRESHOLD) == (0, 1) and clusters.bucketings(2_000_000, clusters.THRESHOLD)[0] > 5


def lone_pairs(seed, n):
    """n pairs with a cosine of 0.87, all else far apart."""
    rng = np.random.default_rng(seed)
    x, y = rng.standard_normal((2, n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return np.concatenate([x, 0.87 * x + np.sqrt(1 - 0.87**2) * y])


def linked_pairs(spark, n, bits, tables, limit):
    cells = [(i, v.astype(np.float16).tobytes()) for i, v in enumerate(lone_pairs(4, n))]
    nodes = spark.createDataFrame(cells, "id bigint, vec binary").repartition(3)
    links = clusters.projection_links(nodes, bits, tables, 0, clusters.THRESHOLD, limit)
    return {(min(r.src, r.dst), max(r.src, r.dst)) for r in links.where("sim >= 0.86").collect()}


def test_lone_pairs_meet_among_many_buckets(spark):
    bits = 8
    agree = 1 - np.arccos(clusters.THRESHOLD) / np.pi
    tables = int(np.ceil(np.log(clusters.MISS) / np.log1p(-(agree**bits))))
    assert linked_pairs(spark, 1500, bits, tables, 4096) >= {(i, i + 1500) for i in range(1500)}


def test_large_buckets_are_compared_whole(spark):
    assert linked_pairs(spark, 1500, 0, 1, 400) >= {(i, i + 1500) for i in range(1500)}


@pytest.mark.parametrize("block", [8192, 7])
def test_no_link_between_members_is_left_out(spark, block):
    # Chains, whose ends aren't alike and whose leaders needn't be, pairs at the threshold, and lone vectors.
    rng = np.random.default_rng(6)
    axes = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    step = np.arccos(clusters.THRESHOLD)
    turned = lambda k, angle: np.cos(angle) * axes[2 * k] + np.sin(angle) * axes[2 * k + 1]
    x = [turned(0, s * 0.9 * step) for s in range(3)]
    x += [turned(1, a) for a in rng.uniform(0, 2.5, 40)]
    x += [turned(2, a) + 0.1 * rng.standard_normal(64) / 8 for a in rng.uniform(0, 1, 60)]
    x += [turned(k, a) for k, near in enumerate((1e-6, -1e-6, 1e-4, -1e-4, 1e-3, -1e-3), 5) for a in (0, step - near)]
    x += [*rng.standard_normal((20, 64))]
    x = np.array(x, np.float32) * rng.uniform(0.1, 9, (len(x), 1)).astype(np.float32)
    ids = rng.permutation(len(x)) * 3 + 1
    ids[:3] = [-1, -2, -3]
    frame = spark.createDataFrame([(int(i), [float(n) for n in v]) for i, v in zip(ids, x)], "faiss_id bigint, embedding array<float>").repartition(3)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    alike = unit @ unit.T >= clusters.THRESHOLD
    np.fill_diagonal(alike, True)
    group = ids.copy()
    for _ in range(len(ids)):
        group = np.array([group[row].min() for row in alike])
    found = clusters.cluster(frame, block=block)
    assert {r.id: r.cluster_id for r in found.collect()} == dict(zip(ids.tolist(), group.tolist()))
    least = {int(i): int(ids[row].min()) for i, row in zip(ids, alike) if row.sum() > 1}
    assert {r.id: r.cluster_id for r in clusters.least_alike(found, frame).collect()} == least
    assert any(least[int(i)] != g for i, g in zip(ids, group) if int(i) in least)


def test_groups_spread_over_blocks_reach_the_lists_as_few_nodes(spark, monkeypatch):
    # A block holds about one row of each group, so blocks hardly contract; lists over all rows cost the disk and the time.
    rows, truth = vectors(12, [30] * 40)
    frame = spark.createDataFrame(random.Random(5).sample(rows, len(rows)), "faiss_id bigint, embedding array<float>")
    sizes, descent = [], clusters.neighbour_descent
    monkeypatch.setattr(clusters, "neighbour_descent", lambda nodes, *a, **k: (sizes.append(nodes.count()), descent(nodes, *a, **k))[1])
    assert {r.id: r.cluster_id for r in clusters.cluster(frame, block=40).collect()} == truth
    assert sizes[0] <= 1.2 * 40


def test_cells_lead_only_alike_nodes(spark):
    rows, truth = vectors(13, [20] * 40 + [1] * 10)
    frame = spark.createDataFrame(rows, "faiss_id bigint, embedding array<float>").repartition(3)
    nodes = clusters.contract_blocks(frame, "faiss_id", "embedding", clusters.THRESHOLD, 1).select("id", "vec")
    led = clusters.contract_cells(nodes, 0.862, 0, 64, 32).collect()
    assert sorted(r.id for r in led) == sorted(truth)
    unit = {i: np.array(e) / np.linalg.norm(e) for i, e in rows}
    assert all(r.rep <= r.id and unit[r.id] @ unit[r.rep] >= clusters.THRESHOLD for r in led)
    assert all((r.vec is not None) == (r.rep == r.id) for r in led)
    assert len({r.rep for r in led}) <= 2 * 50


@pytest.mark.parametrize("most", [262_144, 40])
def test_near_balls_leaves_out_no_ball_within_reach(spark, most):
    # Arcs of rows near to each other's ends, wide and narrow labels, copies, and lone rows.
    rng = np.random.default_rng(14)
    axes = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    cells, i = [], 0
    for g in range(60):
        middle, width = rng.uniform(0, 6), rng.choice([0, 0.05, 0.3, 0.5])
        for _ in range(int(rng.integers(1, 12))):
            t = middle + rng.uniform(-width, width)
            v = np.cos(t) * axes[g % 5] + np.sin(t) * axes[g % 5 + 5] + 0.3 * np.cos(g) * axes[20 + g % 3]
            cells.append((g * 100, g * 100 + i % 3, g * 100 + i % 100, (v / np.linalg.norm(v)).astype(np.float16).tobytes()))
            i += 1
    cells = list({c[2]: c for c in cells}.values())
    balled = clusters.balls(spark.createDataFrame(cells, "label bigint, rep bigint, id bigint, half binary"), clusters.THRESHOLD).cache()
    held = balled.collect()
    unit = lambda cell: (lambda x: x / np.linalg.norm(x))(np.frombuffer(cell, np.float16).astype(np.float64))
    centers = [(r.label, r.ball, unit(r.center), r.least) for r in held if r.center is not None]
    wanted = {(r.id, ball) for r in held for label, ball, c, least in centers if label > r.label and unit(r.half) @ c >= least}
    got = {(r.id, r.ball) for r in clusters.near_balls(balled, most).collect()}
    balled.unpersist()
    assert len(wanted) > 300 and got >= wanted
    assert all(unit_of @ c >= least - 1e-4 for (i, b) in got - wanted for unit_of in [unit(next(r.half for r in held if r.id == i))] for _, ball, c, least in centers if ball == b)


@pytest.mark.parametrize("block", [8192, 7])
def test_typical_members_of_whole_groups(spark, block):
    rows, truth = vectors(8, [60, 9, 2, 1])
    frame = spark.createDataFrame([(i, e, "Abies alba") for i, e in random.Random(4).sample(rows, len(rows))], "faiss_id bigint, embedding array<float>, species string")
    got = {r.cluster_id: r.typical_ids for r in clusters.describe(clusters.cluster(frame, block=block), frame).collect()}
    expected = {}
    for c in {c for c in truth.values() if list(truth.values()).count(c) > 1}:
        ids = np.array([i for i, _ in rows if truth[i] == c])
        unit = np.array([np.array(e, np.float32) / np.linalg.norm(e) for i, e in rows if truth[i] == c])
        expected[c] = ids[np.lexsort((ids, -np.round(unit @ unit.sum(axis=0), 4)))[:3]].tolist()
    assert {c: set(v) for c, v in got.items()} == {c: set(v) for c, v in expected.items()}


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("tel 020 7946 0958 or", "phone", "020 7946 0958"),
        ("phone: 030 1234567", "phone", "030 1234567"),
        ("call 0171-2345678 now", "phone", "0171-2345678"),
        ("212 555 0123 is the fax", "phone", "212 555 0123"),
        ("at +1 (212) 555-0123.", "phone", "+1 (212) 555-0123"),
        ("the passport of the owner is X1234567", "id_number", "X1234567"),
        ("44051401359 | PESEL | Warsaw", "id_number", "44051401359"),
        ("by Jos\\u00e9 Garc\\u00eda, call +33 1 99 00 12 34", "phone", "+33 1 99 00 12 34"),
        ("Thanks to Jos\\u00e9 Garc\\u00eda for it", "person_name", "Jos\\u00e9 Garc\\u00eda"),
    ],
)
def test_details_by_words_and_checksums(text, kind, value):
    assert (kind, value) in [(k, text[s:e]) for k, s, e in pii.find_details(text)]


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        # None of these names is in any list of the module.
        ("Reviewed by Zbigniew Kowalczyk, tel. 12", "person_name", "Zbigniew Kowalczyk"),
        ("we kept the plots that Thandiwe Mokoena plotted again", "person_name", "Thandiwe Mokoena"),
        ("| Ngozi Okonkwo-Bell | ngozi@site.example |", "person_name", "Ngozi Okonkwo-Bell"),
        ("Dear Prof. Wolfram Eichendorff, thanks", "person_name", "Wolfram Eichendorff"),
        ("collector: Tuominen, Aino", "person_name", "Tuominen, Aino"),
        ("0  T. Vasilakis  t.vasilakis%40lab-site.test  3", "email", "t.vasilakis%40lab-site.test"),
    ],
)
def test_details_of_unlisted_names(text, kind, value):
    assert (kind, value) in [(k, text[s:e]) for k, s, e in pii.find_details(text)]


def test_context_weighs_on_every_kind():
    assert pii.find_details("serial = +1 212 555 0184") == [] and pii.find_details("my number is +1 212 555 0184")
    assert pii.find_details("version: 12 Old Mill Road") == [] and pii.find_details("at 12 Old Mill Road")
    for text in ("the Gradient Boosting was fitted", "in New Harbour was", "Random Forest was used"):
        assert pii.find_details(text) == []


def test_weak_shapes_need_their_words_and_checks():
    for text in ("44051401359 | reads | Warsaw", "44051401358 | PESEL | Warsaw", "PESEL 44051401358", "serial 0171-2345678", "n = 212 555 0123"):
        assert pii.find_details(text) == []
