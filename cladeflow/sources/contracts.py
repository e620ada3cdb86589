"""What tables and triggers must be like before they are used, and joins that refuse what doesn't fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of the vectors' metadata, in their order; those that may not be null.
METADATA = (
    "faiss_id", "source_record_number", "record_id", "header", "sequence",
    "kingdom", "phylum", "class", "order", "family", "genus", "species", "source_blob_url",
)
REQUIRED = ("faiss_id", "source_record_number", "record_id", "header", "sequence", "source_blob_url")


def metadata(rows: DataFrame) -> DataFrame:
    """The metadata columns in their order; a missing one raises."""
    missing = [c for c in METADATA if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return rows.select(*METADATA)


def check_metadata(rows: DataFrame) -> None:
    """Raises if required cells are null or vector ids repeat."""
    counted = metadata(rows).agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in REQUIRED]).first()
    empty = [c for c in REQUIRED if counted[c]]
    if empty:
        raise ValueError(f"nulls in {', '.join(empty)}")
    refuse_repeats(rows, "faiss_id")


def refuse_repeats(rows: DataFrame, key: str) -> None:
    """Raises if a key stands in two rows, or in none."""
    if not rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).isEmpty():
        raise ValueError(f"{key} is missing or repeated")


def valid_url(url: Column, host: str, container: str, suffix: str) -> Column:
    """Whether a URL is of https, the host, the container as its first folder, and ends in ``suffix``."""
    path = F.try_parse_url(url, F.lit("PATH"))
    fits = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (F.try_parse_url(url, F.lit("HOST")) == host)
    return F.coalesce(fits & path.startswith(f"/{container}/") & F.lower(path).endswith(suffix.lower()), F.lit(False))


def scope(rows: DataFrame, path: dict[str, str]) -> DataFrame:
    """Rows of a clade, given by the names of its ranks from the top."""
    for rank, name in path.items():
        rows = rows.where(F.col(rank) == name)
    return rows


def length_range(rows: DataFrame, sequence: str, shortest: int = 0, longest: int = 0) -> DataFrame:
    """Rows whose sequence is that long; 0 sets no bound."""
    n = F.length(sequence)
    kept = rows.where(n >= shortest) if shortest else rows
    return kept.where(n <= longest) if longest else kept


def keep_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``ids`` (id)."""
    return rows.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def with_metadata(vectors: DataFrame, described: DataFrame, key: str = "faiss_id") -> DataFrame:
    """Vectors with their metadata; rows without a partner on either side, and repeated ids, raise."""
    for side in (vectors, described):
        refuse_repeats(side, key)
    apart = vectors.select(key, F.lit(1).alias("a")).join(described.select(key, F.lit(1).alias("b")), key, "full").where("a IS NULL OR b IS NULL")
    if not apart.isEmpty():
        raise ValueError(f"vectors and metadata differ in {key}")
    return vectors.join(described, key)


def same_cohort(first: DataFrame, second: DataFrame, key: str, label: str) -> DataFrame:
    """(problem, n): how many ids are on one side only, or have another label on the other; no row if the cohorts are the same."""
    a = first.select(key, F.col(label).alias("a"), F.lit(True).alias("in_a"))
    b = second.select(key, F.col(label).alias("b"), F.lit(True).alias("in_b"))
    problem = F.when(F.col("in_a").isNull(), "only_second").when(F.col("in_b").isNull(), "only_first").when(~F.col("a").eqNullSafe(F.col("b")), "label_differs")
    return a.join(b, key, "full").select(problem.alias("problem")).where("problem IS NOT NULL").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def one_label(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(group, n_labels, label): groups by the number of labels they have in any letter case; one is sound, its least spelling is given."""
    return rows.groupBy(group).agg(F.count_distinct(F.lower(label)).alias("n_labels"), F.min(label).alias(label))


def packed(values: Column) -> Column:
    """An array of numbers as base64 text of little-endian 32-bit floats."""
    return F.pandas_udf(_packed, "string")(values)


def _packed(values: pd.Series) -> pd.Series:
    import base64

    return values.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())


def encode(rows: DataFrame, key: str, sequence: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64, normalised: bool = False) -> DataFrame:
    """(key, vector, normalised): sequences through an encoder that each task makes once and calls with at most ``batch`` at a time.

    Null sequences have null vectors. With ``normalised`` vectors get unit length.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = encoder()
        for part in parts:
            out: list = [None] * len(part)
            at = [i for i, s in enumerate(part["s"]) if s is not None]
            for lo in range(0, len(at), batch):
                chosen = at[lo : lo + batch]
                x = np.asarray(call([part["s"].iloc[i] for i in chosen]), np.float32)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if normalised else x
                for i, v in zip(chosen, x):
                    out[i] = v
            yield pd.DataFrame({"k": part["k"], "vector": out})

    kind = rows.schema[key].dataType.simpleString()
    coded = rows.select(F.col(key).alias("k"), F.col(sequence).alias("s")).mapInPandas(run, f"k {kind}, vector array<float>")
    return coded.select(F.col("k").alias(key), "vector", F.lit(normalised).alias("normalised"))


def pooled(tokens: np.ndarray, mask: np.ndarray, masked: bool) -> np.ndarray:
    """Mean of (n, length, dim) token vectors per sequence, over the tokens of ``mask`` only or over all."""
    weights = mask.astype(np.float32)[:, :, None] if masked else np.ones((*mask.shape, 1), np.float32)
    return (tokens * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), 1)


def plain_label(label: Column, unsafe: Sequence[str] = (":", "(", ")", ",", ";", " ")) -> Column:
    """A label whose signs of tree text and blanks have become underscores."""
    return F.translate(label, "".join(unsafe), "_" * len(unsafe))
