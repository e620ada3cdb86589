"""Byte-level BPE ids of a whole corpus by a sentencepiece model made from the public vocabulary.

The model is serialised straight from the rank file: every token is a piece of
byte-mapped characters whose score is its negative rank, and normalisation is
the identity. Texts are cut into pre-tokens, which are encoded one by one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_ENTRIES = 400_000
SCHEMA = "ids array<int>"

# The contractions that are pre-tokens of their own.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 upwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (x.split() for x in lines if x.strip()))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in ranked]


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the unknown piece comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    letters = byte_letters()
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        piece = model.pieces.add()
        piece.piece, piece.score = "".join(letters[b] for b in token), -float(rank)
        piece.type = pb.ModelProto.SentencePiece.NORMAL
    unknown = model.pieces.add()
    unknown.piece, unknown.score, unknown.type = "<unk>", 0.0, pb.ModelProto.SentencePiece.UNKNOWN
    trainer, normaliser = model.trainer_spec, model.normalizer_spec
    trainer.model_type, trainer.vocab_size = pb.TrainerSpec.BPE, len(tokens) + 1
    trainer.unk_id, trainer.bos_id, trainer.eos_id, trainer.pad_id = len(tokens), -1, -1, -1
    normaliser.name, normaliser.precompiled_charsmap = "identity", b""
    normaliser.add_dummy_prefix = normaliser.remove_extra_whitespaces = normaliser.escape_whitespaces = False
    return model.SerializeToString()


def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            shift = lambda i: i if i < 0xD800 else i + 0x800
            first, last = shift(m.start()), shift(m.end() - 1)
            classes[first : last + 1] = kind
    classes[0xD800:0xE000] = OTHER
    return classes


def pre_tokens(text: str, classes: np.ndarray) -> list[str]:
    """The text cut into runs of letters, numbers, other signs and blanks.

    A space joins the run behind it, contractions stand alone, and of a run of
    blanks before a sign the last is cut off.
    """
    n = len(text)
    if n == 0:
        return []
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = classes[code]
    start = np.empty(n + 1, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    last_blank = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE))
    start[last_blank] = True
    start[last_blank[code[last_blank] == 32] + 1] = False
    for i in np.flatnonzero((code == 39) & start[:n]).tolist():
        ending = text[i + 1 : i + 3]
        if ending[:1] and ending[0] in SHORT_ENDINGS:
            start[i + 1], start[i + 2] = False, True
        elif ending in LONG_ENDINGS:
            start[i + 1], start[i + 3] = False, True
    at = np.flatnonzero(start[:n]).tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], n])]


class Encoder:
    """Ids of texts, with the pre-tokens met lately kept in a bounded cache."""

    def __init__(self, model: bytes, cache_entries: int = CACHE_ENTRIES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown = self.model.unk_id()
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.classes = character_classes()
        self.known: dict[str, bytes] = {}
        self.limit = cache_entries

    def _learn(self, pieces: list[str]) -> None:
        if len(self.known) + len(pieces) > self.limit:
            self.known.clear()
        # A blank has no piece, so nothing merges across it and it comes out as the unknown id.
        mapped = " ".join([p.encode("utf-8").decode("latin-1").translate(self.letters) for p in pieces])
        ids = np.array(self.model.encode(mapped, out_type=int), np.int32)
        cuts = (4 * np.flatnonzero(ids == self.unknown)).tolist()
        packed = ids.tobytes()
        for piece, a, b in zip(pieces, [0, *[c + 4 for c in cuts]], [*cuts, len(packed)]):
            self.known[piece] = packed[a:b]

    def encode(self, text: str | None) -> bytes:
        """The ids as packed 32-bit integers; none for a null or an empty text."""
        if not text:
            return b""
        pieces = pre_tokens(text, self.classes)
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            wanted = set(pieces)
            new = [p for p in wanted if p not in self.known]
            if len(self.known) + len(new) > self.limit:
                new = list(wanted)
            self._learn(new)
            return b"".join(map(self.known.__getitem__, pieces))


def encode_column(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row.

    Null and empty texts have an empty list, blank texts the ids of their
    blanks. Strings of special tokens are ordinary text. Repeated rows stay;
    other columns are ignored. The broadcast model is as large as the
    vocabulary, whatever the corpus.
    """
    model = docs.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            packed = [encoder.encode(x) for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")


def decode_column(encoded: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds ``decoded``, the text of the ids by the inverse byte mapping; null ids give null."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    @F.pandas_udf("string")
    def text_of(column):
        known = tokens.value
        return column.map(lambda x: None if x is None else b"".join([known[i] for i in x]).decode("utf-8", "replace"))

    return encoded.withColumn("decoded", text_of(F.col(ids)))
