"""Byte-level BPE encoding and decoding through a sentencepiece model that is written straight from a rank file.

The model's pieces are the vocabulary's byte strings with each byte mapped to one printable character, scored by the
negative rank, with identity normalisation. Pre-tokens are encoded one by one; ids are ranks; decoding joins the byte
strings of the ids.

Cases: a null text is an empty one; empty texts give no ids; texts of any length are encoded whole; repeated rows give
repeated rows; an empty table gives an empty table; output columns replace columns of the same names.
"""

from __future__ import annotations

import base64
import codecs
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piperack.llm.textcut import by_bytes, safe_chunks, spare

#: Chunks that a task remembers before they become the older ones, of which those that are met again are kept; and
#: pre-tokens in a run for the library, and rows taken at once from a batch.
REMEMBERED, RUN, ROWS = 120_000, 256, 512
#: Stands between pre-tokens: escapes the byte 0xFF, which UTF-8 doesn't use, and which is spelled as no byte is there.
_GAP, _BREAK = "\udcff", "⁇"


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printed else chr(next(spare)) for b in range(256)]


_CHARACTER = dict(enumerate(byte_characters()))
_SPELLING = "".join(byte_characters()[:255]) + _BREAK
_BYTE = {ord(c): b for b, c in _CHARACTER.items()}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model: piece 0 is the unknown piece, which no byte string spells, and rank r is piece r + 1."""
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without a gap")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"{len(missing)} bytes have no rank of their own")
    pieces = [_field(1, "⁇unknown".encode()) + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, p.decode("latin-1").translate(_CHARACTER).encode()) + _field(2, -float(r)) for r, p in enumerate(by_rank)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + b"".join(_field(n, i) for n, i in ((40, 0),))
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))  # no begin, end or padding piece
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


def piece_bytes(spelled: str) -> bytes:
    return bytes(map(_BYTE.__getitem__, map(ord, spelled)))


def pieces_of(model: bytes) -> list[bytes]:
    """The byte strings that a model's ids stand for, by rank."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [piece_bytes(pieces.id_to_piece(i)) for i in range(1, pieces.get_piece_size())]


class Codec:
    """Encoder over one serialised model and one pre-token pattern, for one task."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        spelled = [self.pieces.id_to_piece(i) for i in range(1, self.pieces.get_piece_size())]
        merged = self.pieces.encode(spelled)
        self.odd = {piece_bytes(p): r for r, (p, ids) in enumerate(zip(spelled, merged, strict=True)) if ids != [r + 1]}  # pieces that their merges don't reach
        self.recent: tuple[dict[str, bytes], ...] = ({}, {})  # packed ids of first chunks, and of chunks after a space
        self.older: tuple[dict[str, bytes], ...] = ({}, {})

    def _pack(self, tokens: list[str], starts: np.ndarray) -> list[bytes]:
        """The packed ids of chunks of pre-tokens; chunk k begins with pre-token ``starts[k]``.

        Pre-tokens go to the library in runs, parted by a character that no piece of the vocabulary holds, so that none
        merges with its neighbour."""
        found = []
        for at in range(0, len(tokens), RUN):
            raw = _GAP.join([*tokens[at : at + RUN], ""]).encode("utf-8", "surrogateescape")
            found.append(np.array(self.pieces.encode(codecs.charmap_decode(raw, "strict", _SPELLING)[0]), np.int32))
        ids = np.concatenate(found) - 1
        gaps = np.flatnonzero(ids < 0)
        if self.odd:
            whole = {k: self.odd[b] for k, t in enumerate(tokens) if (b := t.encode()) in self.odd}
            parts = [[whole[k]] if k in whole else part[:-1] for k, part in enumerate(np.split(ids, gaps + 1)[:-1])]
            ids, ends = np.concatenate(parts).astype(np.int32), np.cumsum([0, *map(len, parts)])
        else:
            ends = np.concatenate(([0], gaps - np.arange(len(gaps))))
            ids = ids[ids >= 0]
        flat, cuts = ids.tobytes(), [*(ends[starts] * 4).tolist(), len(ids) * 4]
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, which: int, wanted: list[str], lead: str) -> None:
        """Sees to it that the recent chunks hold all of ``wanted``."""
        recent, older = self.recent[which], self.older[which]
        new = []
        for w in dict.fromkeys(wanted):
            if (known := older.get(w)) is None:
                new.append(w)
            else:
                recent[w] = known
        plain = [w for w in new if w and " " not in w] if lead else []
        if plain:  # a pre-token that starts with a space starts a chunk
            tokens = self.find(" " + " ".join(plain))
            starts = np.flatnonzero(np.fromiter((t[0] == " " for t in tokens), bool, len(tokens)))
            recent.update(zip(plain, self._pack(tokens, starts), strict=True))
        others = [w for w in new if not w or " " in w] if lead else [w for w in new if w]
        if len(plain) + len(others) < len(new):
            recent[""] = b""  # a text that is empty or starts with a space
        if others:
            each = [self.find(lead + w) for w in others]
            starts = np.cumsum([0, *map(len, each[:-1])])
            recent.update(zip(others, self._pack([t for ts in each for t in ts], starts), strict=True))

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as packed 32-bit integers."""
        if sum(map(len, self.recent)) > REMEMBERED:
            self.older, self.recent = self.recent, ({}, {})
        leading, spaced = self.recent
        cut = [safe_chunks(t) for t in texts]
        self._learn(0, [c[0] for c in cut if c[0] not in leading], "")
        get, gaps = spaced.__getitem__, []
        for _, *rest in cut:
            gaps += [c for c in rest if c not in spaced]
        if gaps:
            self._learn(1, gaps, " ")
        return [leading[head] + b"".join(map(get, rest)) for head, *rest in cut]


def model_of(docs: DataFrame, path: str) -> Broadcast:
    """The model as a broadcast; its size is that of the vocabulary, whatever the data."""
    return docs.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(path)))


def _ids(codec: Codec, texts: pa.Array) -> pa.Array:
    sizes, parts = [0], []
    for at in range(0, len(texts), ROWS):
        for group in by_bytes(texts.slice(at, ROWS).to_pylist()):
            packed = codec.encode_packed(group)
            sizes += [len(p) // 4 for p in packed]
            parts.append(b"".join(packed))
    spare()
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _bytes(pieces: list[bytes], lists: pa.Array) -> pa.Array:
    lists = lists.fill_null([]) if lists.null_count else lists
    ends = np.cumsum([0, *lists.value_lengths().to_pylist()]).tolist()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and flat.min() < 0:
        raise ValueError("an id is below 0")
    piece = pieces.__getitem__
    return pa.array((b"".join(map(piece, flat[a:b].tolist())) for a, b in zip(ends, ends[1:], strict=False)), pa.binary(), size=len(lists))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text in ``to``, an array of int."""
    model = model_of(docs, path)

    @F.arrow_udf("array<int>")
    def ids_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(model.value, pattern)  # what it remembers goes with the task
        for texts in parts:
            yield _ids(codec, texts)

    return docs.withColumn(to, ids_of(F.col(text)))


def decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for in ``to``; null ids give empty bytes, ids outside the vocabulary fail."""
    model = model_of(encoded, path)

    @F.arrow_udf("binary")
    def bytes_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = pieces_of(model.value)
        for lists in parts:
            yield _bytes(pieces, lists)

    return encoded.withColumn(to, bytes_of(F.col(ids)))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids", back: str = "decoded") -> DataFrame:
    """What ``decode(encode(docs))`` gives, in one pass through one worker a task."""
    model = model_of(docs, path)

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec, pieces = Codec(model.value, pattern), pieces_of(model.value)
        for texts in parts:
            ids = _ids(codec, texts)
            yield pa.StructArray.from_arrays([ids, _bytes(pieces, ids)], names=["ids", "decoded"])

    found = docs.withColumn("__both", both(F.col(text)))
    return found.withColumns({to: F.col("__both.ids"), back: F.col("__both.decoded")}).drop("__both")


def digest(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts and digests of ids and of decoded bytes, beside doc_id and the columns of ``keep``."""
    return encoded.select(
        "doc_id",
        *keep,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
