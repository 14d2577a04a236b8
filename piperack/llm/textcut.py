"""Cuts of a text that no byte-level tokenizer pattern crosses, and groups of texts of like size."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
_DOUBLE = re.compile(r"\s\s")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_EDGE = re.compile(r"[^\W\d_](?=[\s!-&(-/:-@\[-`{-~])")


def safe_chunks(text: str) -> list[str]:
    """Parts of ``text`` such that ``" ".join(parts) == text`` and a pre-token starts at each of the spaces joined on.

    The byte-level pattern lets one space lead the word, number or sign run after it, and a run of white space before
    a word leaves its last space to that word. A lone space between two other characters therefore always starts a
    pre-token, and so does a lone space at either end. Where white space stands in runs, only the lone spaces cut.
    """
    return _LONE_SPACE.split(text) if _DOUBLE.search(text) else text.split(" ")


def spare() -> None:
    """Gives what a worker has freed back to the system: workers wait for the next stage with what they hold."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_rows(texts: pa.Array, kind: pa.DataType | None = None, at_once: int = 512) -> Iterator:
    """The values of a batch, a few at a time, so that a task holds few of them twice; spare memory goes back at the end."""
    for at in range(0, len(texts), at_once):
        part = texts.slice(at, at_once)
        yield from (part if kind is None else part.cast(kind)).to_pylist()
    spare()


def raw_rows(texts: pa.Array) -> Iterator[bytes | None]:
    return text_rows(texts, pa.binary())


def by_bytes(texts: Iterable[str | None], limit: int = 1 << 20) -> Iterator[list[str]]:
    """``texts`` in order (null: empty), in groups of about ``limit`` bytes of UTF-8; one longer text is a group of its own."""
    group: list[str] = []
    held = 0
    for text in texts:
        text = text or ""
        size = len(text) if text.isascii() else len(text.encode())
        if group and held + size > limit:
            yield group
            group, held = [], 0
        group.append(text)
        held += size
    if group:
        yield group


def short_parts(part: str, specials: re.Pattern | None, limit: int) -> list[str]:
    """``part`` cut after letters that a sign, digit or white space follows, where a byte-level pattern always ends a
    pre-token, into parts of about ``limit`` characters; a special string is a part by itself. A longer run of letters
    is one pre-token and stays whole."""
    if len(part) <= limit:
        return [part]
    out = []
    for k, piece in enumerate(specials.split(part) if specials else [part]):
        if k % 2:  # what the pattern's one group has matched: a special string
            out.append(piece)
            continue
        at = 0
        while len(piece) - at > limit and (edge := _EDGE.search(piece, at + limit)):
            out.append(piece[at : edge.end()])
            at = edge.end()
        out.append(piece[at:])
    return [x for x in out if x]
