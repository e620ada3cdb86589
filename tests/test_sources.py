"""Readers, writers and the trigger stream on small files."""

import base64
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.sources import contracts, readers, writers
from cladeflow.streaming import triggers


def test_dump(spark, tmp_path):
    (tmp_path / "d.tsv").write_text('ProcessID\tBIN\tnucleotides\np1\tBOLD:ABC0123\tAC"GT\np2\t n/a \t\n')
    rows = readers.read_dump(spark, str(tmp_path / "d.tsv"), ["bin_uri", "nuc"])
    got = {r.ProcessID: r for r in readers.clean_columns(rows, ["bin_uri"]).collect()}
    assert got["p1"].nuc == 'AC"GT' and got["p2"].bin_uri is None


def test_fasta_round_trip(spark, tmp_path):
    data = [("r1|x class=Insecta", "ACGT" * 50), ("r2|c__Arachnida", "GG"), ("r3", None)]
    writers.write_fasta(spark.createDataFrame(data, "header string, sequence string"), str(tmp_path / "f"))
    rows = readers.read_fasta(spark, str(tmp_path / "f"))
    assert {(r.record_id, r.header, r.sequence) for r in rows.collect()} == {("r1", data[0][0], data[0][1]), ("r2", data[1][0], "GG")}
    assert [r.record_id for r in readers.class_filter(rows, "insecta").collect()] == ["r1"]


def test_newick(spark, tmp_path):
    (tmp_path / "t.nwk").write_text("(('Ilex ''x'' y':1.5,Acer:0.25)wood[&n={2,[1]}]:0.5,(Poa:4,(Carex:1,Juncus:2)wet:0.75)grass:1.25)all;")
    nodes = {r.label: r for r in readers.read_newick(spark, str(tmp_path / "t.nwk")).collect()}
    assert set(nodes) == {"Ilex 'x' y", "Acer", "wood", "Poa", "Carex", "Juncus", "wet", "grass", "all"}
    assert nodes["Acer"].parent_id == nodes["wood"].node_id and nodes["Ilex 'x' y"].quoted and nodes["all"].parent_id is None
    assert nodes["wet"].edge_length == 0.75 and not nodes["wet"].is_tip and nodes["Juncus"].is_tip
    check = readers.check_newick(spark, str(tmp_path / "t.nwk")).first()
    assert (check.tips, check.internals, check.max_depth, check.unbalanced, check.terminated) == (5, 4, 3, 0, True)


def test_nexus(spark, tmp_path):
    (tmp_path / "t.nex").write_text("#NEXUS\nbegin trees;\n translate 1 Acer, 2 'Poa x';\n tree one = [&R] (1:1,2:2);\n tree two = (2:3,1:4);\nend;\n")
    got = {(r.tree, r.label): r.edge_length for r in readers.read_newick(spark, str(tmp_path / "t.nex")).collect() if r.label}
    assert got == {("t.nex/one", "Acer"): 1.0, ("t.nex/one", "Poa x"): 2.0, ("t.nex/two", "Poa x"): 3.0, ("t.nex/two", "Acer"): 4.0}


def test_tables_of_ids_and_sequences(spark, tmp_path):
    (tmp_path / "ids.tsv").write_text("id\tn\n a \t1\nb\t2\na\t3\n")
    assert {r.id for r in readers.read_ids(spark, str(tmp_path / "ids.tsv"), "id").collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        readers.read_ids(spark, str(tmp_path / "ids.tsv"), "id", most=1)
    (tmp_path / "s.csv").write_text("name,family_name,x\nr1,Rosaceae,acgt-acgtacgtacgtacgtacgt\nr2,Poaceae,\n")
    rows = readers.read_sequences(spark, str(tmp_path / "s.csv")).collect()
    assert [(r.record_id, r.sequence, r.family_name) for r in rows] == [("r1", "ACGT" * 6, "Rosaceae")]
    (tmp_path / "bad.fa").write_text("ACGT\n>a\nAC\n")
    with pytest.raises(Exception, match="before the first header"):
        readers.read_fasta(spark, str(tmp_path / "bad.fa")).collect()
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert readers.file_digests(spark, str(tmp_path / "x.bin")).first().sha256 == hashlib.sha256(b"abc").hexdigest()


def test_publishing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [1, 2]), (2, "b", None)], "id int, k string, v array<int>")
    path = str(tmp_path / "out")
    assert writers.publish(spark, path, {"metadata": rows, "index": rows.select("id")}) == {"metadata": 2, "index": 2}
    with pytest.raises(FileExistsError):
        writers.publish(spark, path, {"index": rows})
    broken = rows.select(F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception):
        writers.publish(spark, str(tmp_path / "half"), {"index": rows, "metadata": broken})
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out"]
    writers.write_report(spark, str(tmp_path / "report"), {"n": 2}, {"rows": rows})
    assert any('"[1,2]"' in f.read_text() for f in (tmp_path / "report" / "rows").glob("part-*"))
    writers.write_by_key(rows.drop("v"), str(tmp_path / "keyed"), "k", 3)
    assert spark.read.parquet(str(tmp_path / "keyed")).count() == 2
    assert writers.append_missing(rows, str(tmp_path / "shards"), "id").count() == 2
    more = rows.unionByName(spark.createDataFrame([(3, "c", [3])], rows.schema))
    assert writers.append_missing(more, str(tmp_path / "shards"), "id").count() == 3
    assert writers.merge_shards(spark, [f"{path}/metadata", f"{path}/index"]).count() == 4


def test_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "faiss_id int, species string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, "w")], "faiss_id int, species string")
    assert {r.problem: r.n for r in contracts.same_cohort(a, b, "faiss_id", "species").collect()} == {"only_first": 1, "only_second": 1, "label_differs": 1}
    assert contracts.same_cohort(a, a, "faiss_id", "species").isEmpty()
    with pytest.raises(ValueError):
        contracts.with_metadata(a, b)
    assert contracts.with_metadata(a, a.withColumnRenamed("species", "s")).count() == 3
    with pytest.raises(ValueError):
        contracts.check_metadata(a)
    urls = spark.createDataFrame([("https://h/in/a.TSV",), ("https://h/out/a.tsv",), ("http://h/in/a.tsv",), (None,)], "u string")
    assert [r.ok for r in urls.select(contracts.valid_url(F.col("u"), "h", "in", ".tsv").alias("ok")).collect()] == [True, False, False, False]
    coded = contracts.encode(a, "faiss_id", "species", lambda: lambda texts: np.array([[len(t), 2.0] for t in texts]), 1, True).collect()
    assert [r.vector and [round(x, 3) for x in r.vector] for r in sorted(coded, key=lambda r: r.faiss_id)] == [[0.447, 0.894]] * 2 + [None]
    tokens, mask = np.array([[[2.0], [4.0]]]), np.array([[1, 0]])
    assert contracts.pooled(tokens, mask, True)[0, 0] == 2 and contracts.pooled(tokens, mask, False)[0, 0] == 3
    text = spark.createDataFrame([([1.0, 2.0],)], "v array<double>").select(contracts.packed(F.col("v")).alias("p")).first().p
    assert np.frombuffer(base64.b64decode(text), "<f4").tolist() == [1.0, 2.0]


def test_triggers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    event = {"eventType": "ObjectCreated", "eventTime": "2024-01-01T00:00:00Z", "data": {"url": "https://h/c/f.tsv", "eTag": "1"}}
    lines = [event, event, event | {"data": {"url": "https://h/c/f.tsv", "eTag": "2"}}, event | {"data": {"url": "ftp://h/f", "eTag": "1"}}]
    (folder / "e.json").write_text("\n".join(map(json.dumps, lines)))
    seen = []
    handle = lambda df, n: seen.extend(r.fingerprint for r in df.collect())
    triggers.ingest(triggers.read_triggers(spark, str(folder)), handle, str(tmp_path / "cp")).awaitTermination(60)
    assert len(seen) == len(set(seen)) == 2
