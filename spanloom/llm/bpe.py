"""Byte-level BPE encoding and decoding through a sentencepiece model.

A rank file (one ``base64 rank`` pair a line) is turned into a sentencepiece
BPE model without any training: each token becomes a piece whose bytes are
written as 256 stand-in characters and whose score is its negative rank.
sentencepiece merges the adjacent pair with the best score, leftmost first,
which is the lowest rank, leftmost first. Normalisation is the identity. The
id of a piece is its rank, and the unknown piece takes the id after the last.

Text is split by the vocabulary's pattern and each pre-token encoded by
itself; decoding looks the bytes of each id up and joins them.

Defined results: null and empty texts give no ids and no bytes; equal rows
give equal ids; doc_id and other columns are not read, so a null there is
kept; an empty table gives an empty table; other columns are kept
unless their name is one of the added ones, which then holds the result. A
text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pre-tokens that a worker keeps encoded; beyond, it starts anew.
CACHE_ENTRIES = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def byte_characters() -> str:
    """256 characters, none of them white space or control, for the bytes in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b if b in set(shown) else next(hidden)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _text(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model file for a rank table whose ranks are 0, 1, 2 and so on."""
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for the bytes {missing[:5]}")
    characters = byte_characters()
    out = bytearray()
    for rank, token in enumerate(by_rank):
        piece = "".join(characters[b] for b in token).encode()
        out += _text(1, _text(1, piece) + b"\x15" + struct.pack("<f", -rank) + _number(3, 1))
    out += _text(1, _text(1, b"<unk>") + b"\x15" + struct.pack("<f", -len(by_rank)) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(by_rank) + 1) + _number(40, len(by_rank)) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normaliser = _text(1, b"identity") + _text(2, b"") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(out + _text(2, trainer) + _text(3, normaliser))


class Codec:
    """Encodes and decodes; one a process, as it holds the model and a cache."""

    def __init__(self, ranks: dict[bytes, int], model: bytes, pattern: str):
        import sentencepiece

        self.pieces = sorted(ranks, key=ranks.__getitem__)
        # Ids are kept as packed 32-bit integers: joining bytes is all that a known part costs.
        self.packed = [struct.pack("<i", r) for r in range(len(self.pieces))]
        self.ids = dict(zip(self.pieces, self.packed, strict=True))
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.map = dict(enumerate(byte_characters()))
        # White space is Unicode's property, not the wider str.isspace().
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.whole_words = r" ?\p{L}+|" in pattern and r" ?[^\s\p{L}\p{N}]+" in pattern
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def pre_tokens(self, text: str) -> list[str]:
        """The pattern's matches; a word, with its space before and one mark after, needs no search if words stay whole."""
        if self.whole_words:
            body = text[1:] if text[:1] == " " else text
            if body.isalpha():
                return [text]
            if body[-1:] in _MARKS and body[:-1].isalpha():
                return [text[:-1], text[-1]]
        return self.pattern.findall(text)

    def _encode_new(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text: a pre-token that is a token is its rank, others go through the model's merges."""
        found: list[list[bytes | None]] = []
        mapped: list[str] = []
        for text in texts:
            raw = [token.encode() for token in self.pre_tokens(text)]
            ids = [self.ids.get(x) for x in raw]
            if None in ids:
                mapped += [x.decode("latin-1").translate(self.map) for x, packed in zip(raw, ids, strict=True) if packed is None]
            found.append(ids)
        merged = iter(self.processor.encode(mapped, num_threads=1) if mapped else ())
        pack = self.packed.__getitem__
        return [b"".join([b"".join(map(pack, next(merged))) if x is None else x for x in ids]) for ids in found]

    def _known(self, cache: dict[str, bytes], parts: set[str], prefix: str) -> None:
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        if new := [p for p in parts if p not in cache]:
            cache.update(zip(new, self._encode_new([prefix + p for p in new]), strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text.

        A single space before a visible character always begins a pre-token,
        so the parts between such spaces are encoded, and remembered, apart;
        those that are new go to the model in one call, as a call is dear.
        """
        plain: set[str] = set()
        spaced: set[str] = set()
        cut = []
        for text in texts:
            if _ODD_SPACE.search(text):
                parts = _BEFORE_WORD.split(text)
                plain.update(parts)
                cut.append((parts, ()))
            else:
                first, *rest = text.split(" ")
                plain.add(first)
                spaced.update(rest)
                cut.append(((first,), rest))
        self._known(self.plain, plain, "")
        self._known(self.spaced, spaced, " ")
        plain_ids, spaced_ids = self.plain.__getitem__, self.spaced.__getitem__
        return [b"".join(map(plain_ids, parts)) + b"".join(map(spaced_ids, rest)) for parts, rest in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


#: Texts encoded together.
ROWS = 250
_MARKS = tuple(".,;:!?")
_ODD_SPACE = re.compile(r" (?:\s|\Z)")
_BEFORE_WORD = re.compile(r"(?= \S)")
_codecs: dict[bytes, Codec] = {}


def _codec(shared) -> Codec:
    ranks, pattern = shared.value
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _codecs:
        table = {bytes(t): int(r) for r, t in enumerate(_unpacked(ranks))}
        _codecs[key] = Codec(table, serialise_model(table), pattern)
    return _codecs[key]


def _packed(ranks: dict[bytes, int]) -> bytes:
    return b"".join(struct.pack("<H", len(t)) + t for t in sorted(ranks, key=ranks.__getitem__))


def _unpacked(blob: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(blob):
        (n,) = struct.unpack_from("<H", blob, at)
        yield blob[at + 2 : at + 2 + n]
        at += 2 + n


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the column of ids, and with ``decoded`` one of the bytes that the ids decode to.

    The vocabulary is read on the driver and broadcast: its size is that of
    the file, whatever the documents are.
    """
    keep = [f for f in documents.schema.fields if f.name not in (ids, decoded)]
    schema = T.StructType([*keep, T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.BinaryType())] if decoded else []))
    shared = documents.sparkSession.sparkContext.broadcast((_packed(load_ranks(ranks_path)), pattern))
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = codec.encode_all([t or "" for t in part.column(text).to_pylist()])
                ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
                values = np.frombuffer(b"".join(found), np.int32)
                columns = [part.column(n) for n in names] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]
                if decoded:
                    columns.append(pa.array([codec.decode(np.frombuffer(x, np.int32).tolist()) for x in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, ids, *([decoded] if decoded else [])])

    return documents.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes that the column of ids decodes to; null ids give no bytes."""
    keep = [f for f in encoded.schema.fields if f.name != decoded]
    names = [f.name for f in keep]
    shared = encoded.sparkSession.sparkContext.broadcast((_packed(load_ranks(ranks_path)), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            out = pa.array([codec.decode(x or ()) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), out], names=[*names, decoded])

    return encoded.mapInArrow(run, T.StructType([*keep, T.StructField(decoded, T.BinaryType())]))
