"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, and decoding.

The rank file is turned into a ``tokenizers`` BPE model: bytes become characters by
the usual byte-to-character mapping, and every split of a token into two tokens is a
merge, in the order of the ranks. A text is cut by the pattern, each distinct piece is
encoded once and kept in a bounded cache, and the ids of a text are those of its
pieces. Pieces go to the model one by one: a batch call of so short texts costs more in threads, one
set for each task, and in offsets than their merges. Decoding reverses the byte table; as a token may end inside a character, bytes
are joined before they are read as characters.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces longer than this are not kept; the cache starts anew at CACHE_PIECES pieces.
CACHE_CHARS = 48
CACHE_PIECES = 400_000
SLICE_ROWS = 256

# Texts of these characters alone are cut by an equivalent pattern of the faster ``re``:
# in these ranges it has the same letters, numbers and white space.
_PLAIN = re.compile("[^\t-\r -~À-ÖØ-öø-ɏ–-…]")
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\\s{_L}0-9]+|\\s+(?!\\S)|\\s+")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import models

        ranks = read_ranks(path)
        char = byte_characters()
        spell = {t: "".join(char[b] for b in t) for t in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            halves = [(token[:i], token[i:]) for i in range(1, len(token))]
            halves = sorted((ranks[a], ranks[b], a, b) for a, b in halves if a in ranks and b in ranks)
            merges += [(spell[a], spell[b]) for _, _, a, b in halves]
        vocab = {spell[t]: r for t, r in ranks.items()}
        self.model = models.BPE(vocab=vocab, merges=merges, ignore_merges=True)
        self.char = {chr(b): c for b, c in char.items()}
        self.latin = str.maketrans(self.char)
        self.table = {r: t for t, r in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return (self.pattern if _PLAIN.search(text) else _PLAIN_PATTERN).findall(text)

    def _spelled(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.latin)

    def _packed(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(self._spelled(piece))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out = []
        for text in texts:
            pieces = self.pieces(text)
            cache = self.cache
            try:
                out.append(b"".join([cache[p] for p in pieces]))
                continue
            except KeyError:
                fresh = {p for p in pieces if p not in cache}
            own = {p: self._packed(p) for p in fresh}
            out.append(b"".join([own[p] if p in own else cache[p] for p in pieces]))
            if len(cache) + len(own) > CACHE_PIECES:
                self.cache = cache = {}
            cache.update((p, v) for p, v in own.items() if len(p) <= CACHE_CHARS)
        return out

    def decode(self, ids) -> bytes:
        """Bytes of the tokens; an unknown id raises KeyError."""
        return b"".join(map(self.table.__getitem__, ids))

    def offsets(self, text: str, ids) -> list[tuple[int, int]]:
        """Character span of each token; a token holding part of a character spans the whole of it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        at = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
        ends = list(accumulate(len(self.table[i]) for i in ids))
        starts = [0, *ends[:-1]]
        return [(int(at[s]), int(at[e - 1]) + 1) for s, e in zip(starts, ends)]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The worker process's codec; it is built once and serves all its batches."""
    return Codec(path, pattern)


def _slices(batches, rows: int = SLICE_ROWS):
    """Batches in slices, so that the ids of a few texts at a time are in memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False, round_trip: bool = False) -> DataFrame:
    """``docs`` with ``ids array<int>`` and, if wanted, ``offsets array<struct<start,end>>`` in characters,
    and ``round_trip boolean``: decoding the ids, in the same task, gives the text's bytes again.

    Whole texts are encoded, without special tokens. Defined cases: a null text is
    encoded as the empty one (no ids); repeated rows stay; columns called ``ids``,
    ``offsets`` or ``round_trip`` are replaced; an empty table gives an empty result. ``path`` must be
    readable on the executors.
    """
    rest = [c for c in docs.columns if c not in ("ids", "offsets", "round_trip")]
    schema = docs.select(*rest).schema.add("ids", T.ArrayType(T.IntegerType()))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    if offsets:
        schema = schema.add("offsets", T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())))
    if round_trip:
        schema = schema.add("round_trip", T.BooleanType())

    def run(batches):
        made = codec(path, pattern)
        for batch in _slices(batches):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            packed = [np.frombuffer(p, "<u4").astype(np.int32) for p in made.packed(texts)]
            columns = [*batch.columns, pa.array(packed, pa.list_(pa.int32()))]
            names = [*batch.schema.names, "ids"]
            if offsets:
                spans = [[{"start": s, "end": e} for s, e in made.offsets(t, p.tolist())] for t, p in zip(texts, packed)]
                columns, names = [*columns, pa.array(spans, span)], [*names, "offsets"]
            if round_trip:
                same = [made.decode(p.tolist()) == t.encode() for t, p in zip(texts, packed)]
                columns, names = [*columns, pa.array(same, pa.bool_())], [*names, "round_trip"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*rest).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded binary``, the bytes of its ids, and ``decoded_text string``.

    Bytes that are no valid text (ids cut inside a character) show as U+FFFD in
    ``decoded_text``. Null ids give nulls.
    """
    rest = [c for c in encoded.columns if c not in ("decoded", "decoded_text")]
    schema = encoded.select(*rest).schema.add("decoded", T.BinaryType()).add("decoded_text", T.StringType())

    def run(batches):
        made = codec(path, pattern)
        for batch in _slices(batches):
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            raw = [None if r is None else made.decode(r) for r in rows]
            columns = [*batch.columns, pa.array(raw, pa.binary()), pa.array([None if r is None else r.decode(errors="replace") for r in raw], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "decoded", "decoded_text"])

    return encoded.select(*rest).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode every text and decode the ids again; ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.

    The ids and bytes are hashed where they are made, so that only digests leave the task.
    Nulls, empty texts and repeated rows are treated as in ``encode``.
    """

    def run(batches):
        made = codec(path, pattern)
        sha = hashlib.sha256
        for batch in _slices(batches):
            packed = made.packed([t or "" for t in batch.column(1).to_pylist()])
            back = [made.decode(np.frombuffer(p, "<u4").tolist()) for p in packed]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([sha(p).hexdigest() for p in packed]),
                    pa.array([sha(b).hexdigest() for b in back]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, schema)
