"""Readers of barcode dumps, sequence files, trees and event triggers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.functions.text import blank_clean

# Names that a dump may give its columns.
SYNONYMS = {"nuc": ("nuc", "nucleotides"), "bin_uri": ("bin_uri", "bin"), "marker_code": ("marker_code", "marker")}
ABOUT = ("phylum", "class", "order", "family", "genus", "species", "bin_uri", "taxon")
NODES = "tree string, node_id bigint, parent_id bigint, label string, quoted boolean, is_tip boolean, edge_length double"


def read_dump(spark: SparkSession, path: str, required: Sequence[str] = (), encoding: str = "UTF-8") -> DataFrame:
    """A tab-separated dump with a header, every cell as text and quotes as ordinary characters; gzip is read as it is.

    Column names are taken in any letter case, and known synonyms renamed. A
    missing required column raises.
    """
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("encoding", encoding).csv(path)
    by_case = {c.lower(): c for c in rows.columns}
    for name, others in SYNONYMS.items():
        found = next((by_case[o] for o in others if o in by_case), None)
        if found and found != name:
            rows = rows.withColumnRenamed(found, name)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return rows


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, header, record_id, sequence); files are cut at record starts, so large ones are read in parallel.

    ``ordinal`` grows along each file, though not by one. Text before a file's
    first header raises; a header without letters has an empty sequence.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("ordinal"), F.col("_metadata.file_block_start").alias("_at"), "value")
    first = records.groupBy("path").agg(F.min(F.struct("_at", "ordinal")).alias("_first"))
    headed = records.join(F.broadcast(first), "path").withColumn("_first", F.col("_first.ordinal") == F.col("ordinal"))
    checked = F.when(F.col("_first") & ~F.ltrim("value").startswith(">") & (F.length(F.trim("value")) > 0), F.raise_error(F.lit("sequence before the first header"))).otherwise(F.col("value"))
    text = F.regexp_replace("value", r"^\s*>", "")
    header = F.trim(F.regexp_extract(text, r"^([^\r\n]*)", 1))
    body = F.upper(F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"\s", ""))
    sound = headed.withColumn("value", checked).where(F.length(F.trim("value")) > 0)
    return sound.select("path", "ordinal", header.alias("header"), F.regexp_extract(header, r"^([^|\s]*)", 1).alias("record_id"), body.alias("sequence"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, sequence, …) of a sequence file, or of a table by its suffix (.tsv, .txt, .csv) with the columns that say what a record is.

    The id is the first column named processid, sequenceid or id, else the first
    column; the sequence is nucleotides, sequence or nuc, else the first column
    whose first value is more than 20 letters of a sequence. Gaps are taken out,
    rows without a sequence left out.
    """
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in ("tsv", "csv", "txt"):
        return read_fasta(spark, path).select("record_id", "sequence", "header")
    rows = spark.read.option("sep", "," if suffix == "csv" else "\t").option("header", True).csv(path)
    by_case = {c.lower(): c for c in reversed(rows.columns)}
    key = next((by_case[c] for c in ("processid", "sequenceid", "id") if c in by_case), rows.columns[0])
    sequence = next((by_case[c] for c in ("nucleotides", "sequence", "nuc") if c in by_case), None)
    if sequence is None:
        first = rows.first()
        looks = lambda v: v is not None and len(v) > 20 and not set(v.upper()) - set("ACGTN-")
        sequence = next((c for c in rows.columns if first is not None and looks(first[c])), None)
        if sequence is None:
            raise ValueError(f"no column of sequences in {path}")
    about = [c for c in rows.columns if c not in (key, sequence) and any(k in c.lower() for k in ABOUT)]
    clean = F.upper(F.replace(F.col(f"`{sequence}`"), F.lit("-"), F.lit("")))
    return rows.select(F.col(f"`{key}`").alias("record_id"), clean.alias("sequence"), *[F.col(f"`{c}`") for c in about]).where("length(sequence) > 0")


def read_ids(spark: SparkSession, path: str, column: str, most: int = 10_000_000) -> DataFrame:
    """(id): the distinct trimmed ids of a table's column; ragged rows, an unknown column and more than ``most`` ids raise."""
    head = spark.read.option("sep", "\t").option("header", True).csv(path).columns
    if column not in head:
        raise ValueError(f"no column {column} in {path}")
    schema = ", ".join(f"`{c}` string" for c in head)
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "FAILFAST").option("quote", "").csv(path)
    # Every column is read, so that a row with too few or too many cells is noticed.
    whole = rows.where(F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in head])) >= 0)
    ids = whole.select(F.trim(F.col(f"`{column}`")).alias("id")).where("id != ''").distinct()
    if ids.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} ids in {path}")
    return ids


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """A sidecar table with its lists split: ``lineages`` array<string>, ``counts`` array<bigint>."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    counts = F.transform(F.split("counts", r"\|"), lambda c: c.cast("bigint"))
    return rows.withColumns({"lineages": F.split("lineages", r"\|"), "counts": counts, "n_lineages": F.col("n_lineages").cast("int"), "records": F.col("records").cast("bigint")})


def check_newick(spark: SparkSession, path: str) -> DataFrame:
    """(path, tips, internals, annotated, quoted, max_depth, unbalanced, terminated) of each tree file; quotes and comments are skipped.

    The order of signs matters, so a file is one task.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    token = re.compile(r"'[^']*(?:'|\Z)|\[[^\]]*(?:\]|\Z)|[(),;]")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, text in zip(part["path"], part["value"]):
                tips = inner = notes = quotes = depth = deepest = ended = 0
                before = ""
                for sign in token.findall(text):
                    kind = sign[0]
                    notes, quotes = notes + (kind == "["), quotes + (kind == "'")
                    if kind in "['":
                        continue
                    tips += kind in ",)" and before in ("(", ",")
                    inner, ended = inner + (kind == ")"), ended or int(kind == ";")
                    depth += {"(": 1, ")": -1}.get(kind, 0)
                    deepest = max(deepest, depth)
                    before = before if kind == ";" else kind
                out.append((name, tips, inner, notes, quotes, deepest, depth, bool(ended)))
            yield pd.DataFrame(out, columns=["path", "tips", "internals", "annotated", "quoted", "max_depth", "unbalanced", "terminated"])

    return files.mapInPandas(run, "path string, tips bigint, internals bigint, annotated bigint, quoted bigint, max_depth bigint, unbalanced bigint, terminated boolean")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files; one file is read whole by one task."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def parse_newick(text: str) -> Iterator[tuple[int, int | None, str | None, bool, bool, float | None]]:
    """(node_id, parent_id, label, quoted, is_tip, edge_length) in preorder of closing; nested comments are skipped."""
    token = re.compile(r"'(?:[^']|'')*'|[(),;:]|\[|[^\s(),;:\[\]']+")
    nodes: list[list] = [[None, None, False, None, 0]]
    at, pos = 0, 0
    stack: list[int] = []
    length_next = False
    while m := token.search(text, pos):
        pos, t = m.end(), m.group(0)
        if t == "[":
            depth = 1
            while depth and pos < len(text):
                depth += {"[": 1, "]": -1}.get(text[pos], 0)
                pos += 1
            if depth:
                raise ValueError("a comment isn't closed")
        elif t == "(":
            stack.append(at)
            nodes.append([at, None, False, None, 0])
            nodes[at][4] += 1
            at = len(nodes) - 1
        elif t == ",":
            if not stack:
                raise ValueError("a comma outside of brackets")
            nodes.append([stack[-1], None, False, None, 0])
            nodes[stack[-1]][4] += 1
            at = len(nodes) - 1
        elif t == ")":
            if not stack:
                raise ValueError("a bracket closes that none opened")
            at = stack.pop()
        elif t == ":":
            length_next = True
        elif t == ";":
            break
        elif length_next:
            nodes[at][3], length_next = float(t), False
        else:
            quoted = t.startswith("'")
            nodes[at][1], nodes[at][2] = (t[1:-1].replace("''", "'") if quoted else t), quoted
    if stack:
        raise ValueError("a bracket isn't closed")
    for i, (parent, label, quoted, length, children) in enumerate(nodes):
        yield i, parent, label, quoted, children == 0, length


def nexus_trees(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(name, Newick text, labels by token) of every tree in a NEXUS file's trees block."""
    block = re.search(r"(?is)begin\s+trees\s*;(.*?)\bend\s*;", text + "\nend;")
    if not block:
        raise ValueError("no trees block")
    body = block.group(1)
    table = re.search(r"(?is)\btranslate\b(.*?);", body)
    names = {}
    for entry in re.findall(r"([^\s,]+)\s+('(?:[^']|'')*'|[^\s,]+)", table.group(1) if table else ""):
        names[entry[0]] = entry[1][1:-1].replace("''", "'") if entry[1].startswith("'") else entry[1]
    for m in re.finditer(r"(?is)\btree\s+\*?\s*('(?:[^']|'')*'|[^\s=]+)\s*=\s*((?:'(?:[^']|'')*'|\[[^\]]*\]|[^;'\[])*;)", body):
        yield m.group(1).strip("'"), m.group(2), names


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """The nodes table of tree files, all trees of a NEXUS file with its labels translated; one file is one task, as its brackets can't be split.

    Trees are named by their file, those of NEXUS files by file and tree.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("tree"), "value")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for tree, text in zip(part["tree"], part["value"]):
                nexus = text.lstrip().lower().startswith("#nexus")
                found = ((f"{tree}/{n}", body, names) for n, body, names in nexus_trees(text)) if nexus else [(tree, text, {})]
                for name, body, names in found:
                    rows = [(name, i, p, names.get(label, label), *rest) for i, p, label, *rest in parse_newick(body)]
                    out = pd.DataFrame(rows, columns=["tree", "node_id", "parent_id", "label", "quoted", "is_tip", "edge_length"])
                    yield out.astype({"parent_id": "Int64"})

    return files.mapInPandas(run, NODES)


def class_filter(records: DataFrame, wanted: str) -> DataFrame:
    """Sequence records whose header names a class as ``class=``, ``class:`` or ``c__``, in any letter case."""
    named = F.regexp_extract("header", r"(?i)(?:class[=:]|c__)\s*([^|;,\s]+)", 1)
    return records.where(F.lower(named) == wanted.lower())


def clean_columns(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns with blanks collapsed and placeholders as null."""
    return rows.withColumns({n: blank_clean(F.col(n)) for n in names if n in rows.columns})
