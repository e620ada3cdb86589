"""Held-out items that leak into a corpus, found by a positional inverted index.

The index is a table of postings: for each term of a segment of documents, the
documents that have it and its positions in them. Segments are bounded runs of
documents, so a term that stands everywhere is split over all of them, and
building it needs no shuffle. It holds every term, is written once to the shared
folder and answers any items. A query takes the postings of the items' terms,
aligns those of each item window's rarest terms with the item (offset-adjusted
lists) and intersects them with those of the window's other terms.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.session import Scratch

WINDOW = 13
ITEMS_PER_BLOCK = 20_000
SEGMENT_WORDS = 1_000_000
SEGMENT_DOCS = 4096

WORD = re.compile(r"[^\W_]+")
CONTROL = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
ESCAPE = re.compile(r"\\+(?:u([0-9a-fA-F]{4})|[nrtbf])")
ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z]+\d*);")
LINK = re.compile(r"\]\([^()\s]*\)")
# The element names that count as markup.
TAG = re.compile(
    r"</?(?:a|b|big|blockquote|br|center|code|dd|del|details|div|dl|dt|em|font|h[1-6]|hr|i|img|ins|kbd|li|mark|ol|p|pre|q|s|samp"
    r"|small|span|strike|strong|sub|summary|sup|table|tbody|td|tfoot|th|thead|tr|tt|u|ul|var)\b[^<>]*>",
    re.IGNORECASE,
)
UNSEEN = re.compile("[­​-‍⁠﻿]")


def _character(m: re.Match) -> str:
    return chr(int(m.group(1), 16)) if m.group(1) else " "


def words(text: str | None) -> list[str]:
    """Words of letters and digits, without markup, escapes, terminal codes and letter case."""
    if not text:
        return []
    if "\\" in text:
        text = ESCAPE.sub(_character, text)
    if "\x1b" in text:
        text = CONTROL.sub(" ", text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text and ENTITY.search(text):
        for _ in range(2):
            text = ENTITY.sub(lambda m: html.unescape(m.group(0)), text)
        text = TAG.sub(" ", text)
    if "](" in text:
        text = LINK.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", UNSEEN.sub("", text))
    return WORD.findall(text.lower())


class Items:
    """A block of items as one array of term ids; items are parted by a term no document has."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        kept = [(i, w) for i, w in ((i, words(t)) for i, t in rows) if len(w) >= WINDOW]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in kept for w in ws}))}
        terms, owner = [], []
        for item, ws in kept:
            terms += [*[self.vocabulary[w] for w in ws], -2]
            owner += [item] * (len(ws) + 1)
        self.terms, self.owner = np.array(terms, np.int32), np.array(owner, np.int64)

    def anchors(self, frequency: np.ndarray, rarest: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the ``rarest`` terms of every window, ordered by term; and where each term's places begin."""
        n = len(self.terms)
        if n < WINDOW:
            return np.zeros(0, np.int64), np.zeros(len(self.vocabulary) + 1, np.int64)
        views = np.lib.stride_tricks.sliding_window_view(self.terms, WINDOW)
        whole = np.flatnonzero((views >= 0).all(axis=1))
        rank = np.argsort(frequency[views[whole]], axis=1, kind="stable")[:, :rarest]
        places = np.unique((whole[:, None] + rank).ravel())
        places = places[np.argsort(self.terms[places], kind="stable")]
        return places, np.searchsorted(self.terms[places], np.arange(len(self.vocabulary) + 1))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(segment, term, docs, counts, positions): postings of every term; ``counts`` says how many positions belong to each document.

    Null and empty texts have no postings; repeated documents have their own each.
    """

    def segment_rows(number: int, keys: pa.Array, terms: list[str], ids: np.ndarray, owner: np.ndarray, position: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")  # within a term by document and position
        ids, owner, position = ids[order], owner[order], position[order]
        entry = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])]))
        counts = np.diff(np.concatenate([entry, [len(ids)]]))
        entries_of = np.searchsorted(ids[entry], np.arange(len(terms) + 1))
        positions_of = np.searchsorted(ids, np.arange(len(terms) + 1))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(terms), number)),
                pa.array(terms, pa.string()),
                _lists(entries_of, keys.take(pa.array(owner[entry]))),
                _lists(entries_of, pa.array(counts.astype(np.int32))),
                _lists(positions_of, pa.array(position.astype(np.int32))),
            ],
            names=["segment", "term", "docs", "counts", "positions"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys, bodies, known, size = [], [], {}, 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(b) for b in bodies])
            ends = np.cumsum(lengths)
            owner = np.repeat(np.arange(len(bodies)), lengths)
            position = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
            return segment_rows(number, pa.concat_arrays(keys), list(known), np.concatenate(bodies), owner, position)

        for batch in batches:
            for at, body in enumerate(batch.column(1).to_pylist()):
                found = words(body)
                if not found:
                    continue
                keys.append(batch.column(0).slice(at, 1))
                bodies.append(np.array([known.setdefault(w, len(known)) for w in found], np.int32))
                size += len(found)
                if size >= SEGMENT_WORDS or len(keys) >= SEGMENT_DOCS:
                    yield flush()
                    number += 1
                    keys, bodies, known, size = [], [], {}, 0
        if keys:
            yield flush()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).where(F.col(text).isNotNull()).mapInArrow(
        run, f"segment bigint, term string, docs array<{kind}>, counts array<int>, positions array<int>"
    )


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


_stored: dict[tuple, DataFrame] = {}


def stored_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written index of a corpus; later queries of the application on the same frame of the same files read it again."""
    spark = docs.sparkSession
    name = (spark.sparkContext.applicationId, docs.semanticHash(), tuple(sorted(docs.inputFiles())), key, text)
    if name not in _stored:
        _stored[name] = Scratch(spark, "postings").keep(build_index(docs, key, text))
    return _stored[name]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one segment at a time; input is sorted by segment."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        number = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[0].column(0)[0] != batch.column(0)[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _matches(items: Items, places: np.ndarray, begins: np.ndarray, segment: pa.Table, edits: int):
    """(entry of the segment's documents, item, 13 less the edits) of windows that stand in a document with at most ``edits`` edits."""
    flat = [segment.column(c).combine_chunks() for c in range(1, 5)]
    documents = flat[1].flatten()
    counts = flat[2].flatten().to_numpy(zero_copy_only=False)
    positions = flat[3].flatten().to_numpy(zero_copy_only=False)
    term = np.repeat(flat[0].to_numpy(zero_copy_only=False), np.diff(flat[3].offsets.to_numpy()))
    codes = documents.dictionary_encode()
    docs = np.repeat(codes.indices.to_numpy(zero_copy_only=False), counts)
    n_docs = len(codes.dictionary)
    # Documents lie side by side, far enough apart that no alignment reaches into the next.
    apart = WINDOW + edits
    last = np.zeros(n_docs, np.int64)
    np.maximum.at(last, docs, positions)
    base = np.cumsum(np.concatenate([[2 * apart], last + 3 * apart]))
    line = np.full(base[-1] + 2 * apart, -1, np.int32)
    spot = base[docs] + positions
    line[spot] = term
    # Offset-adjusted lists: every posting of an anchor term with every place of that term in the items.
    fan = begins[term + 1] - begins[term]
    hit = np.flatnonzero(fan)
    fan = fan[hit]
    step = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
    place = places[np.repeat(begins[term[hit]], fan) + step]
    spot, doc = np.repeat(spot[hit], fan), np.repeat(docs[hit], fan)
    padded = np.concatenate([np.full(WINDOW, -2, np.int32), items.terms, np.full(WINDOW, -2, np.int32)])
    reach = np.arange(-WINDOW + 1, WINDOW)
    out = [(doc[:0], items.owner[place[:0]], doc[:0])]
    for lo in range(0, len(place), 200_000):
        p, s, d = place[lo : lo + 200_000], spot[lo : lo + 200_000], doc[lo : lo + 200_000]
        # A window with few edits has words in place within three of the anchor.
        shifts = range(-edits, edits + 1)
        near = sum(np.any([line[s + k + x] == padded[p + WINDOW + k] for x in shifts], axis=0).astype(np.int8) for k in (-3, -2, -1, 1, 2, 3))
        keep = np.flatnonzero(near >= max(0, 3 - edits))
        p, s, d = p[keep], s[keep], d[keep]
        own = padded[p[:, None] + WINDOW + reach]
        same = np.any([line[s[:, None] + reach + x] == own for x in shifts], axis=0) & (own >= 0)
        # Only windows within the item: the parting term matches nothing, and bounds them.
        zero = np.zeros((len(p), 1), np.int32)
        sums = np.concatenate([zero, np.cumsum(same, axis=1)], axis=1)
        walls = np.concatenate([zero, np.cumsum(own < 0, axis=1)], axis=1)
        total = np.where(walls[:, WINDOW:] == walls[:, :-WINDOW], sums[:, WINDOW:] - sums[:, :-WINDOW], 0)
        at, window = np.nonzero(total >= WINDOW - edits)
        if edits:
            off = WINDOW - 1 - window  # of the anchor within the window
            text = line[(s[at] - off - edits)[:, None] + np.arange(WINDOW + 2 * edits)]
            needed = _edits(padded[(p[at] - off + WINDOW)[:, None] + np.arange(WINDOW)], text)
            good = needed <= edits
            at, needed = at[good], needed[good]
        else:
            needed = np.zeros(len(at), np.int64)
        out.append((d[at], items.owner[p[at]], WINDOW - needed))
    doc, item, matched = (np.concatenate(x) for x in zip(*out))
    return codes.dictionary, doc, item, matched


def _edits(windows: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Least number of words to replace, insert or leave out that turns each window into a stretch of its text."""
    row = np.zeros((len(windows), texts.shape[1] + 1), np.int64)
    for i in range(windows.shape[1]):
        following = np.empty_like(row)
        following[:, 0] = i + 1
        for j in range(texts.shape[1]):
            replaced = row[:, j] + (windows[:, i] != texts[:, j])
            following[:, j + 1] = np.minimum(replaced, np.minimum(row[:, j + 1], following[:, j]) + 1)
        row = following
    return row.min(axis=1)


def leaks(
    docs: DataFrame, items: DataFrame, edits: int = 0, key: str = "doc_id", text: str = "text", block: int = ITEMS_PER_BLOCK
) -> DataFrame:
    """(doc_id, item_id, matched): documents with a passage of WINDOW words of an item, up to ``edits`` words replaced, inserted or left out.

    ``edits`` 0 asks for exact phrases, more for proximity matches; of each
    window the ``edits`` + 1 rarest terms are looked up, of which a match has
    one at least in its place. ``matched`` is WINDOW less the fewest edits.
    Items are taken as a stated query set, in blocks of ``block``; items with
    fewer than WINDOW words or without text match nothing, nor do null and
    empty texts. Repeated documents each count; so do repeated items, once.
    """
    spark = docs.sparkSession
    index = stored_index(docs, key, text)
    asked = items.select("item_id", "item_text").where("item_id IS NOT NULL").distinct()
    n_blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("_b", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)))
    kind = docs.schema[key].dataType.simpleString()
    found = []
    for b in range(n_blocks):
        chosen = Items(sorted((tuple(r) for r in asked.where(F.col("_b") == b).select("item_id", "item_text").collect()), key=repr))
        vocabulary = F.broadcast(spark.createDataFrame(list(chosen.vocabulary.items()), "term string, term_id int"))
        postings = index.join(vocabulary, "term")
        seen = postings.groupBy("term_id").agg(F.sum(F.size("docs")).alias("n")).collect()
        frequency = np.zeros(len(chosen.vocabulary), np.int64)
        for term, n in seen:
            frequency[term] = n
        places, begins = chosen.anchors(frequency, edits + 1)
        query = spark.sparkContext.broadcast((chosen, places, begins))

        def run(batches: Iterator[pa.RecordBatch], query=query) -> Iterator[pa.RecordBatch]:
            items_, places_, begins_ = query.value
            for segment in _segments(batches):
                names, doc, item, best = _matches(items_, places_, begins_, segment, edits)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(doc, pa.int64())), pa.array(item, pa.int64()), pa.array(best, pa.int32())], names=[key, "item_id", "matched"]
                )

        sent = postings.select("segment", "term_id", "docs", "counts", "positions").repartition("segment").sortWithinPartitions("segment")
        found.append(sent.mapInArrow(run, f"`{key}` {kind}, item_id bigint, matched int"))
    everything = found[0]
    for more in found[1:]:
        everything = everything.unionByName(more)
    return everything.groupBy(key, "item_id").agg(F.max("matched").alias("matched"))
