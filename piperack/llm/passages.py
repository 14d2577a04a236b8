"""Substring near-duplicates by compact windows.

The tokens of a text are its shingles of five words. For each of a few hash functions the Cartesian tree over the
tokens' hashes gives the compact windows: a node (l, c, r) stands for all sequences [i, j] with l <= i <= c <= j <= r,
whose min-hash is that of c. Nodes too narrow for a passage are left out.

Windows of distinct texts are grouped by function and min-hash. Groups of up to ``GROUP`` texts take all their pairs.
Larger ones, as frequent lines or families of copies make, are split by sub-keys: of two passages that are similar
enough 41 of 46 tokens are the same, so but for texts that repeat a few words over and over 25 words in a row are, and
the runs of 18 words that are marked near the windows of such a group are chosen so that those share a mark. Groups of
one mark are paired as before where they are small; else members are told by the tokens around the run, some 340 bytes,
and those that differ go with the smallest and with the largest key. Where sub-keys, which span 45 words, still meet in
several connected components, they are drawn out to whole passages: members of one such key are similar all with all, so
each goes with one of them. So a pair is left out only where a chain of verified links joins its texts already, no key
takes all its pairs, and lines that many texts share make as many pairs as texts.

The windows of a pair are joined as intervals: two windows with one min-hash allow a range of starts along their
alignment, and starts that enough functions cover, or a marked run, are candidates. Only then the texts are joined, and
the candidates verified: the passages of the least length there must have a Jaccard similarity of ``similarity`` over
tokens, aligned to within three words. Connected components of the verified links are the classes.

Cases: a null text or one with fewer words than a passage has no passages; texts of any length are searched whole;
documents with equal texts of a passage's length or more are of one class; a document without id takes part, and its
class has the smallest id there is, or null; repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piperack.llm.decontamination import words_of
from piperack.llm.shared import connected_components, freed, kept, removed, stored
from piperack.llm.textcut import raw_rows

#: Words of a token, words of the shortest passage, hash functions, functions that must agree, and the similarity.
SHINGLE, PASSAGE, FUNCTIONS, ENOUGH, SIMILARITY = 5, 50, 4, 2, 0.8
#: Texts of a group that takes all its pairs; words of a marked run, words in a row that make sure of a common mark, and its function.
GROUP, RUN_WORDS, SAME, RUN = 8, 18, 25, 7
_BAND = 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WINDOW = pa.struct([("l", pa.int32()), ("c", pa.int32()), ("r", pa.int32())])
_RUN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
RUNS, WINDOWS = "array<struct<first:int,last:int>>", "array<struct<l:int,c:int,r:int>>"


def _tokens(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` consecutive words, given by their hashes."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * _BASE + words[k : k + len(out)]
    return out


def tokens_of(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each shingle of ``size`` words."""
    import xxhash

    return _tokens(np.fromiter(map(xxhash.xxh64_intdigest, words_of(text)), np.uint64), size)


def hashed(tokens: np.ndarray, function: int) -> np.ndarray:
    """The value of each token under one hash function; its lowest bits name the function."""
    x = tokens ^ np.uint64((function + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    for shift in (32, 29, 32):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return (x & np.uint64(0xFFFFFFFFFFFFFFF8)) | np.uint64(function)


def _sliding(best, values: np.ndarray, width: int) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over each ``width`` values in a row."""
    out, span = values, 1
    while span * 2 <= width:
        out, span = best(out[:-span], out[span:]), span * 2
    return best(out[: len(values) - width + 1], out[width - span :][: len(values) - width + 1])


def _minima(values: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """The places of the minima of the stretches of ``least`` values from ``starts``: what can be a node ``least`` wide.
    Of equal values in a stretch the first is the smaller."""
    if not len(starts):
        return np.empty(0, int)
    lows = _sliding(np.minimum, values, least)
    low = np.zeros(len(lows), np.uint64)
    low[starts] = lows[starts]
    edge = np.zeros(least - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.maximum, np.concatenate((edge, low, edge)), least) == values)  # a stretch over it has no smaller value
    again = np.flatnonzero((values[at[1:]] == values[at[:-1]]) & (at[1:] - at[:-1] < least))
    if len(again):  # the next stretch after the equal value before it must still have no smaller one
        k = np.searchsorted(starts, at[again] + 1)
        after = starts[np.minimum(k, len(starts) - 1)]
        held = (k < len(starts)) & (after <= at[again + 1]) & (low[after] == values[at[again]])
        at = np.delete(at, again[~held] + 1)
    return at


def _nearest_smaller(heights: np.ndarray, stop: np.ndarray, step: int) -> np.ndarray:
    """For each height the index of the nearest one in direction ``step`` that is smaller, or to the left equal; at
    most one past ``stop``, the last of its text. Every round jumps over what the neighbour has jumped over."""
    at = np.arange(len(heights)) + step
    todo = np.arange(len(heights))
    while len(todo):
        there = at[todo]
        todo = todo[(there - stop[todo]) * step <= 0]
        there = at[todo]
        higher = heights[there] > heights[todo] if step < 0 else heights[there] >= heights[todo]
        todo = todo[higher]
        at[todo] = at[at[todo]]
    return at


def cartesian_windows(values: np.ndarray, owner: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes (l, c, r) that are ``least`` wide or more of the Cartesian trees over the values of several texts that
    stand one after the other; ``starts`` are the stretches of ``least`` values that stay in their text, ``owner`` the
    text of each value. Of equal values the first is the smaller."""
    c = _minima(values, starts, least)
    heights, text = values[c], owner[c]
    low, high = np.searchsorted(text, text, "left"), np.searchsorted(text, text, "right") - 1
    left, right = _nearest_smaller(heights, low, -1), _nearest_smaller(heights, high, 1)
    first, end = np.searchsorted(owner, text, "left"), np.searchsorted(owner, text, "right")
    l = np.where(left >= low, c[np.maximum(left, 0)] + 1, first)  # noqa: E741
    r = np.where(right <= high, c[np.minimum(right, len(c) - 1)] - 1, end - 1)
    return l, c, r


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The compact windows over the values of one text."""
    n = len(values)
    if n < least:
        return []
    found = cartesian_windows(values, np.zeros(n, int), np.arange(n - least + 1), least)
    return list(zip(*(x.tolist() for x in found), strict=True))


def windows_of(raws: list[bytes], passage: int = PASSAGE, functions: int = FUNCTIONS, spans: bool = True) -> tuple[np.ndarray, ...]:
    """text, min-hash, l, c, r of the compact windows of several texts, worked out together; the places are those of
    tokens in their text. Also the words' hashes of all texts, and where each text's words start. Without ``spans`` the
    text and the min-hash of each node alone."""
    import xxhash

    least = passage - SHINGLE + 1
    words = [words_of(raw) for raw in raws]
    sizes = np.array([len(w) for w in words], int)
    flat = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    tokens = _tokens(flat, SHINGLE)
    of_word = np.repeat(np.arange(len(raws)), sizes)
    left = begin[of_word + 1] - np.arange(len(flat)) - (SHINGLE - 1)  # tokens from here to the end of the text
    valid = np.flatnonzero(left[: len(tokens)] > 0)
    owner, left = of_word[valid], left[valid]
    starts = np.flatnonzero(left >= least)
    found = []
    for f in range(functions if len(starts) else 0):
        values = hashed(tokens[valid], f)
        if not spans:
            at = _minima(values, starts, least)
            found.append((owner[at], values[at]))
            continue
        l, c, r = cartesian_windows(values, owner, starts, least)  # noqa: E741
        base = begin[owner[c]]
        found.append((owner[c], values[c], valid[l] - base, valid[c] - base, valid[r] - base))
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, t) for t in (int, np.uint64, int, int, int)][: 5 if spans else 2]
    return *columns, flat, begin


def run_windows(flat: np.ndarray, begin: np.ndarray, passage: int = PASSAGE) -> tuple[np.ndarray, ...]:
    """text, mark, l, c, r of the marked runs of several texts, given by their words' hashes: as a window, a run at the
    token c stands for the sequences of a passage's length that hold it."""
    values = hashed(_tokens(flat, RUN_WORDS), RUN)
    of_word = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    starts = np.flatnonzero(begin[of_word + 1] - np.arange(len(flat)) >= SAME)
    at = _minima(values, starts, SAME - RUN_WORDS + 1) if len(starts) else starts
    text = of_word[at]
    place, tokens = at - begin[text], begin[text + 1] - begin[text] - SHINGLE + 1
    return text, values[at], np.maximum(place - (passage - RUN_WORDS), 0), place, np.minimum(place + passage - SHINGLE, tokens - 1)


def _place(hashes: np.ndarray, filter_words: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(3)).astype(np.int64) & (len(filter_words) * 64 - 1)


def _is_in(filter_words: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (filter_words[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def key_filter(keys: DataFrame, key: str, most_bits: int = 1 << 27) -> Broadcast:
    """A bitmap over hashes, of 16 bits a key and ``most_bits`` at most, however many keys there are.

    It only thins what is joined exactly afterwards: a key of the table always passes, and some others do.
    """
    bits = min(most_bits, 1 << max(10, (16 * keys.count()).bit_length()))
    place = F.shiftrightunsigned(key, 3).bitwiseAND(F.lit(bits - 1)).alias("p")
    words = keys.select(place).select(F.expr("p >> 6").cast("int").alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def may_be_in(kept_keys: Broadcast, key: str) -> Column:
    """If a key may be one of those of a filter."""

    @F.arrow_udf("boolean")
    def test(keys: pa.Array) -> pa.Array:
        return pa.array(_is_in(kept_keys.value, _place(keys.to_numpy().view(np.uint64), kept_keys.value)))

    return test(F.col(key))


def _groups_of_bytes(raws: Iterable[bytes], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    group, held = [], 0
    for raw in raws:
        group.append(raw)
        held += len(raw)
        if held > limit:
            yield group
            group, held = [], 0
    if group:
        yield group


def min_hashes(text: Column, passage: int = PASSAGE) -> Column:
    """The distinct min-hashes of a text's compact windows, as an array of long."""

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        ends, found = [0], []
        for group in _groups_of_bytes(raw_rows(texts)):
            who, what, *_ = windows_of(group, passage, spans=False)
            order = np.lexsort((what, who))
            who, what = who[order], what[order]
            fresh = _fresh(who, what)
            found.append(what[fresh].view(np.int64))
            ends += (ends[-1] + np.searchsorted(who[fresh], np.arange(len(group)), "right")).tolist()
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))

    return of(text)


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """If a row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return out


def marks_of(raws: list[bytes], few: np.ndarray | None, many: np.ndarray | None, passage: int = PASSAGE) -> tuple[np.ndarray, ...]:
    """text, hash, l, c, r in this order: the windows of several texts whose min-hash may be in the filter ``few``, and
    in the place of those whose min-hash may be in ``many`` the marked runs that a passage they stand for may hold."""
    least = passage - SHINGLE + 1
    who, what, l, c, r, flat, begin = windows_of(raws, passage)  # noqa: E741
    crowded = np.zeros(len(who), bool) if many is None else _is_in(many, _place(what, many))
    plain = ~crowded if few is None else ~crowded & _is_in(few, _place(what, few))
    rows = [tuple(x[plain] for x in (who, what, l, c, r))]
    if crowded.any():
        at, own = begin[who[crowded]], [x[crowded] for x in (l, c, r)]
        starts = np.zeros(len(flat) + 2, np.int64)
        np.add.at(starts, at + np.maximum(own[0], own[1] - least + 1), 1)
        np.add.at(starts, at + np.minimum(own[1], own[2] - least + 1) + 1, -1)
        covered = np.concatenate(([0], np.cumsum(np.cumsum(starts) > 0)))
        runs = run_windows(flat, begin, passage)
        at = begin[runs[0]]
        near = covered[at + runs[3] + 1] > covered[at + runs[2]]
        rows.append(tuple(x[near] for x in runs))
    columns = [np.concatenate(x) for x in zip(*rows, strict=True)]
    order = np.lexsort((columns[3], columns[1], columns[0]))
    return tuple(x[order] for x in columns)


def _nested(parts: list[tuple[int, tuple[np.ndarray, ...]]]) -> pa.Array:
    """For each text its hashes, and for each hash its windows, of parts of (number of texts, marks)."""
    texts, lists, flat = [np.zeros(1, int)], [np.zeros(1, int)], []
    for n, (who, what, *places) in parts:
        heads = np.flatnonzero(_fresh(who, what))
        texts.append(texts[-1][-1] + np.searchsorted(who[heads], np.arange(n), "right"))
        lists.append(np.concatenate((heads[1:], [len(who)]))[: len(heads)] + sum(len(x[1]) for x in flat))
        flat.append((what[heads], *places))
    hashes, *places = (np.concatenate(x) for x in zip(*flat, strict=True)) if flat else (np.empty(0, np.uint64), *[np.empty(0, int)] * 3)
    windows = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in places], fields=list(_WINDOW))
    marks = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.concatenate(lists), pa.int32()), windows)], names=["hash", "windows"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(texts), pa.int32()), marks)


def shared_marks(text: Column, few: Broadcast, many: Broadcast, passage: int = PASSAGE) -> Column:
    """``marks_of`` a text, as hashes with their windows."""

    @F.arrow_udf(f"array<struct<hash:bigint,windows:{WINDOWS}>>")
    def of(texts: pa.Array) -> pa.Array:
        return _nested([(len(g), marks_of(g, few.value, many.value, passage)) for g in _groups_of_bytes(raw_rows(texts))])

    return of(text)


def contexts_of(raws: list[bytes], wanted: np.ndarray, passage: int = PASSAGE) -> tuple[np.ndarray, ...]:
    """text, mark, context and place of the marked runs of several texts whose mark may be in the filter ``wanted``.

    A context holds 32 bits of each token that a passage with the run may have, and of ``_BAND`` more at either end; 0
    stands where the text has none."""
    import xxhash

    words = [words_of(raw) for raw in raws]
    begin = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(int)
    flat = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, int(begin[-1]))
    who, mark, _, place, _ = run_windows(flat, begin, passage)
    keep = _is_in(wanted, _place(mark, wanted))
    who, mark, place = who[keep], mark[keep], place[keep]
    if not len(who):
        return who, mark, np.empty((0, _span(passage)), np.uint32), place
    short = (_tokens(flat, SHINGLE) >> np.uint64(16)).astype(np.uint32) | np.uint32(1)
    at = place[:, None] + np.arange(_span(passage)) - (passage - RUN_WORDS + _BAND)
    inside = (at >= 0) & (at < (np.diff(begin)[who] - SHINGLE + 1)[:, None])
    return who, mark, np.where(inside, short[np.clip(begin[who][:, None] + at, 0, len(short) - 1)], np.uint32(0)), place


def _span(passage: int) -> int:
    """Tokens of a context."""
    return passage - RUN_WORDS + passage - SHINGLE + 1 + 2 * _BAND


def common_starts(one: np.ndarray, other: np.ndarray, passage: int = PASSAGE, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """For each two contexts of one mark the first and the last start, from the run on, of passages with the run that
    are similar enough; a last start before the first one where none is."""
    least, room = passage - SHINGLE + 1, passage - RUN_WORDS
    need = int(np.ceil(2 * least * similarity / (1 + similarity) - 1e-9))
    inner = one[:, _BAND : one.shape[1] - _BAND]
    same = np.zeros(inner.shape, bool)
    for k in range(2 * _BAND + 1):
        same |= inner == other[:, k : k + inner.shape[1]]
    sums = np.cumsum(np.pad((same & (inner > 0)).astype(np.int32), ((0, 0), (1, 0))), axis=1)
    there = (inner > 0) & (other[:, _BAND : other.shape[1] - _BAND] > 0)
    good = (sums[:, least:] - sums[:, :-least] >= need) & there[:, : room + 1] & there[:, least - 1 :]
    first = np.where(good.any(axis=1), good.argmax(axis=1), room + 1)
    last = np.where(good.any(axis=1), room - good[:, ::-1].argmax(axis=1), -1)
    return first - room, last - room


class _Parts:
    """Hashes of stretches of words of contexts, and if the texts have them."""

    def __init__(self, contexts: np.ndarray):
        self.width = width = contexts.shape[1]
        self.prefix, self.power = np.zeros((len(contexts), width + 1), np.uint64), np.multiply.accumulate(np.array([1, *[_BASE] * width], np.uint64))
        self.there = np.zeros((len(contexts), width + 1), np.int32)
        for t in range(width):
            self.prefix[:, t + 1] = self.prefix[:, t] * _BASE + contexts[:, t]
            self.there[:, t + 1] = self.there[:, t] + (contexts[:, t] > 0)

    def of(self, first: int, words: int, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """The hash of so many words from a token on, and if the text has them."""
        last = first + words - SHINGLE + 1
        if first < 0 or last > self.width:
            return self.prefix[rows, 0], np.zeros(len(self.prefix[rows]), bool)
        return self.prefix[rows, last] - self.prefix[rows, first] * self.power[last - first], self.there[rows, last] - self.there[rows, first] == last - first


def _keyed(marks: np.ndarray, tag: int, *parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A key of each mark, tag and stretches, and if all of these are there."""
    key, ok = marks * np.uint64(0xD6E8FEB86659FD93) + np.uint64(tag), np.ones(len(marks), bool)
    for value, inside in parts:
        key, ok = (key ^ (key >> np.uint64(29))) * _BASE + value, ok & inside
    return key, ok


def edit_keys(contexts: np.ndarray, marks: np.ndarray, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """context, key, if it is plain, and its code of the keys that contexts of one mark share if they share a similar passage.

    Of the 46 tokens of a passage 5 may differ. So two similar passages are the same but for five words at the ends,
    and share 45 words in a row from one of the ``SAME - RUN_WORDS + 1`` words before their first mark; or but for one
    word, which another one replaces or which one of them lacks, and share the longer side of at least 25 words, whose
    mark next to the word is as near to it, and the other side. A key of the second kind takes a side of 25, 30, 35 or
    40 words with 20, 15, 10 or 5 words of the other one, either after one word (not plain) or at once (plain); two
    plain keys only say that the words go on. Every key spans 45 words, so lines of fewer words share none."""
    mid, slack, parts, found = passage - RUN_WORDS + _BAND, SAME - RUN_WORDS + 1, _Parts(contexts), []

    def put(code: int, tag: int, plain: bool, *stretches: tuple[np.ndarray, np.ndarray]) -> None:
        key, ok = _keyed(marks, tag, *stretches)
        at = np.flatnonzero(ok)
        found.append((at, key[at], np.full(len(at), plain), np.full(len(at), code, np.int32)))

    for o in range(slack):
        put(64 * o, 1, False, parts.of(mid - o, passage - SHINGLE))
        for n, side in enumerate(range(SAME, passage - SHINGLE, SHINGLE)):
            rest = passage - SHINGLE - side
            after, before = mid + RUN_WORDS + o, mid - o  # the first word after the longer side, and its own first word
            for plain, gap in ((False, 1), (True, 0)):
                put(64 * o + 1 + 4 * n + plain, 2 + n, plain, parts.of(after - side, side), parts.of(after + gap, rest))
                put(64 * o + 3 + 4 * n + plain, 12 + n, plain, parts.of(before, side), parts.of(before - gap - rest, rest))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def full_keys(contexts: np.ndarray, marks: np.ndarray, at: np.ndarray, codes: np.ndarray, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """context, key and if it is plain of what the keys with these ``codes`` of contexts ``at`` lack to a whole passage.

    45 words in a row are those of a passage that begins 0 to 5 words before them, if the text has it. Two sides of 45
    words are continued by the four words, in any share at either end, that a passage with one word changed must have in
    common besides. So contexts of one full key, unless both are plain, share a passage that is similar enough, all
    with all; and similar passages share a full key."""
    mid, parts, found = passage - RUN_WORDS + _BAND, _Parts(contexts), []
    order = np.argsort(codes, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else []:
        code, own = int(codes[rows[0]]), at[rows]
        o, kind = divmod(code, 64)
        tries = []
        if not kind:
            run = parts.of(mid - o, passage - SHINGLE, own)
            tries = [(100 + i, (run, (np.zeros(len(own), np.uint64), parts.of(mid - o - i, passage, own)[1]))) for i in range(SHINGLE + 1)]
        else:
            n, (back, plain) = (kind - 1) // 4, divmod((kind - 1) % 4, 2)
            side, gap, after, before = SAME + SHINGLE * n, 1 - plain, mid + RUN_WORDS + o, mid - o
            rest = passage - SHINGLE - side
            for i in range(SHINGLE):
                more = SHINGLE - 1 - i
                both = (parts.of(before, side + i, own), parts.of(before - gap - rest - more, rest + more, own)) if back else (parts.of(after - side - i, side + i, own), parts.of(after + gap, rest + more, own))
                tries.append((200 + 64 * i + 2 * n + back, both))
        for tag, stretches in tries:
            key, ok = _keyed(marks[own], tag, *stretches)
            found.append((own[ok], key[ok], np.full(int(ok.sum()), bool(kind and plain))))
    if not found:
        return np.empty(0, int), np.empty(0, np.uint64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def run_contexts(text: Column, wanted: Broadcast, passage: int = PASSAGE) -> Column:
    """hash, context and places of the wanted marked runs of a text, each different context once."""

    @F.arrow_udf("array<struct<hash:bigint,context:binary,places:array<int>>>")
    def of(texts: pa.Array) -> pa.Array:
        sizes, lists, marks, contexts, places = [np.zeros(1, int)], [np.zeros(1, int)], [], [], []
        for group in _groups_of_bytes(raw_rows(texts)):
            who, mark, context, place = contexts_of(group, wanted.value, passage)
            told = np.zeros(len(who), np.uint64)
            for t in range(context.shape[1]):
                told = (told ^ (told >> np.uint64(31))) * _BASE + context[:, t]
            order = np.lexsort((place, told, mark, who))
            who, mark, told = who[order], mark[order], told[order]
            heads = np.flatnonzero(_fresh(who, mark, told))
            sizes.append(sizes[-1][-1] + np.searchsorted(who[heads], np.arange(len(group)), "right"))
            lists.append(np.concatenate((heads[1:], [len(who)]))[: len(heads)] + sum(map(len, places)))
            marks.append(mark[heads])
            contexts.append(context[order[heads]].tobytes())
            places.append(place[order])
        n, width = sum(map(len, marks)), 4 * _span(passage)
        ends = pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes())
        binary = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(b"".join(contexts))])
        flat = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0, t), pa.from_numpy_dtype(t))
        where = pa.ListArray.from_arrays(pa.array(np.concatenate(lists), pa.int32()), flat([p.astype(np.int32) for p in places], np.int32))
        rows = pa.StructArray.from_arrays([flat([m.view(np.int64) for m in marks], np.int64), binary, where], names=["hash", "context", "places"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(sizes), pa.int32()), rows)

    return of(text)


def _unions(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of the intervals of each key, touching ones made one."""
    if not len(key):
        return key, first, last
    order = np.lexsort((first, key))
    key, first, last = key[order], first[order], last[order]
    width = int(last.max() - first.min()) + 3  # keys set apart, so that one running maximum serves all
    shift = np.cumsum(_fresh(key)) * width
    reach = np.maximum.accumulate(last + shift)
    heads = np.ones(len(key), bool)
    heads[1:] = (first + shift)[1:] > reach[:-1] + 1
    at = np.flatnonzero(heads)
    return key[at], first[at], (reach - shift)[np.concatenate((at[1:], [len(key)])) - 1]


def _progressions(c: np.ndarray, l: np.ndarray, r: np.ndarray, least: int = 8) -> list[tuple[int, int, int, int, int]]:  # noqa: E741
    """Windows as (first c, last c, step, l, r): stretches of ``least`` or more that stand equally far apart are one."""
    if len(c) < least:
        return [(x, x, 0, y, z) for x, y, z in zip(c.tolist(), l.tolist(), r.tolist(), strict=True)]
    gaps = np.diff(c)
    edges = np.flatnonzero(np.concatenate(([True], gaps[1:] != gaps[:-1], [True])))
    out, done = [], 0
    for x, y in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        if y - x + 1 >= least:  # windows x to y, both included
            out += [(c[k], c[k], 0, l[k], r[k]) for k in range(done, x)]
            out.append((c[x], c[y], gaps[x], l[x : y + 1].min(), r[x : y + 1].max()))
            done = y + 1
    return [tuple(map(int, w)) for w in out] + [(int(c[k]), int(c[k]), 0, int(l[k]), int(r[k])) for k in range(done, len(c))]


def _met(one: list[tuple], other: list[tuple], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alignments with their first and last starts, for the windows of one hash in two texts that repeat it many times.
    Two progressions of one step are laid over one another end to end, so that all of either is covered."""
    found = []
    for a0, a1, step, la, ra in one:
        for b0, b1, other_step, lb, rb in other:
            if step and other_step and step != other_step:
                lines = {x - y for x in range(a0, a1 + 1, step) for y in range(b0, b1 + 1, other_step)}
            elif step or other_step:
                low, high = sorted((a0 - b0, a1 - b1))
                lines = {low, high, *range(low, high, max(step or other_step, min(a1 - a0, b1 - b0)))}
            else:
                lines = {a0 - b0}
            found += [(d, max(la, lb + d, a0 - least + 1, b0 + d - least + 1), min(a1, b1 + d, ra - least + 1, rb + d - least + 1)) for d in lines]
    return tuple(np.array(found, int).reshape(-1, 3).T)


def join_windows(pair: np.ndarray, hashes: np.ndarray, one: tuple, other: tuple, passage: int = PASSAGE, enough: int = ENOUGH, most: int = 1 << 20, many: int = 1 << 10) -> tuple[np.ndarray, ...]:
    """pair, alignment, first and last start of the passages that enough functions, or a marked run, allow.

    Row k holds the windows of one hash in the two texts of ``pair[k]``; ``one`` and ``other`` are (ends, l, c, r) of
    their lists of windows. Of each two windows their starts along the alignment are joined, in parts of about ``most``
    rows; where there are over ``many`` of them, windows that stand equally far apart are first made one. Then the
    starts that enough functions cover on alignments near each other are picked out by a sweep."""
    least = passage - SHINGLE + 1
    (ends_a, la, ca, ra), (ends_b, lb, cb, rb) = one, other
    row = np.repeat(np.arange(len(pair)), np.diff(ends_a))  # one for each window of the first text
    crowded = np.diff(ends_a) * np.diff(ends_b) > many
    m = np.where(crowded, 0, np.diff(ends_b))[row]
    cuts = np.searchsorted(np.cumsum(m), np.arange(most, int(m.sum()), most))
    function = (hashes & np.uint64(7)).astype(int)
    keys, firsts, lasts = [], [], []
    span = 1 << 22  # of alignments; texts are shorter
    for k in np.flatnonzero(crowded).tolist():
        x, y = slice(ends_a[k], ends_a[k + 1]), slice(ends_b[k], ends_b[k + 1])
        d, first, last = _met(_progressions(ca[x], la[x], ra[x]), _progressions(cb[y], lb[y], rb[y]), least)
        fits = first <= last
        key = (pair[k] * 2 * span + d + span) * 8 + function[k]
        for to, z in zip((keys, firsts, lasts), _unions(key[fits], first[fits], last[fits]), strict=True):
            to.append(z)
    for part in np.split(np.arange(len(row)), np.unique(cuts)):
        n = m[part]
        i = np.repeat(part, n)
        j = ends_b[:-1][row[i]] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        d = ca[i] - cb[j]
        first = np.maximum(np.maximum(la[i], lb[j] + d), ca[i] - least + 1)
        last = np.minimum(np.minimum(ca[i], ra[i] - least + 1), rb[j] + d - least + 1)
        fits = first <= last
        key = ((pair[row[i]] * 2 * span + d + span) * 8 + function[row[i]])[fits]
        for to, x in zip((keys, firsts, lasts), _unions(key, first[fits], last[fits]), strict=True):
            to.append(x)
    if not keys:
        return tuple(np.empty(0, int) for _ in range(4))
    key, first, last = _unions(*(np.concatenate(x) for x in (keys, firsts, lasts)))
    lines = np.unique(key >> 3)
    near = np.concatenate([((key >> 3) + k << 3) | (key & 7) for k in range(-_BAND, _BAND + 1)])
    times = 2 * _BAND + 1
    first, last = np.tile(first, times), np.tile(last, times)
    real = np.isin(near >> 3, lines)
    near, first, last = _unions(near[real], first[real], last[real])
    weight = np.where((near & 7) == RUN, enough, 1)
    line = np.concatenate((near, near)) >> 3
    at, change = np.concatenate((first, last + 1)), np.concatenate((weight, -weight))
    order = np.lexsort((at, line))
    line, at, change = line[order], at[order], change[order]
    good = np.cumsum(change)[:-1] >= enough
    good &= at[1:] > at[:-1]
    good &= line[1:] == line[:-1]
    line, first, last = _unions(line[:-1][good], at[:-1][good], at[1:][good] - 1)
    return line // (2 * span), line % (2 * span) - span, first, last


_CANDIDATES = pa.list_(pa.struct([("d", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))


def candidate_starts(shared: Column, passage: int = PASSAGE) -> Column:
    """For a pair of texts, given by its shared hashes with the windows in either text, alignments and ranges of starts."""

    @F.arrow_udf("array<struct<d:int,first:int,last:int>>")
    def of(pairs: pa.Array) -> pa.Array:
        rows = pairs.flatten()
        ends = np.concatenate(([0], np.cumsum(pairs.value_lengths().to_numpy())))
        sides = []
        for name in ("a", "b"):
            windows = rows.field(name)
            flat = windows.flatten()
            sides.append((np.concatenate(([0], np.cumsum(windows.value_lengths().to_numpy()))), *(flat.field(k).to_numpy().astype(int) for k in ("l", "c", "r"))))
        pair = np.repeat(np.arange(len(pairs)), np.diff(ends))
        found, d, first, last = join_windows(pair, rows.field("hash").to_numpy().view(np.uint64), *sides, passage)
        starts = np.searchsorted(found, np.arange(len(pairs) + 1))
        flat = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (d, first, last)], fields=list(_CANDIDATES.value_type))
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat)

    return of(shared)


@lru_cache(maxsize=32)  # pairs of one text come one after the other
def _sorted_tokens(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a text, their order by value, and the tokens in that order."""
    tokens = tokens_of(raw)
    order = np.argsort(tokens, kind="stable")
    return tokens, order, tokens[order]


def verified_runs(one: bytes, other: bytes, candidates: np.ndarray, passage: int = PASSAGE, similarity: float = SIMILARITY) -> list[list[tuple[int, int]]]:
    """For either text the runs of words (first, last), disjoint and in order, of the candidates that are similar enough.

    A candidate is a row (alignment, first start, last start). A stretch of a passage's length is similar enough where
    so many of its tokens stand in the other text within ``_BAND`` of the alignment."""
    least = passage - SHINGLE + 1
    need = int(np.ceil(2 * least * similarity / (1 + similarity) - 1e-9))
    (a, _, _), (b, order, values) = _sorted_tokens(one), _sorted_tokens(other)
    good, also = np.zeros(max(0, len(a) - least + 1), bool), np.zeros(max(0, len(b) - least + 1), bool)
    candidates = np.asarray(candidates, int).reshape(-1, 3)
    low = np.maximum(np.maximum(candidates[:, 1], 0), candidates[:, 0])
    high = np.minimum(np.minimum(candidates[:, 2], len(a) - least), len(b) + candidates[:, 0] - least)
    by_size = np.lexsort((low, candidates[:, 0], low - high))
    by_size = by_size[(low <= high)[by_size]]
    if not len(by_size):
        return [[], []]
    begin, end = np.searchsorted(values, a, "left"), np.searchsorted(values, a, "right")
    n = end - begin
    few = n.sum() <= 16 * (len(a) + len(b))
    if few:  # all places of a token in either text, by alignment
        i = np.repeat(np.arange(len(a)), n)
        j = order[np.repeat(begin, n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
        width = len(a) + 1  # lines set apart
        key = np.sort((i - j + len(b)) * width + i)
        i, line = key % width, key // width - len(b)
        heads = np.flatnonzero(np.concatenate(([True], np.diff(key) != 1)))
        sizes = np.diff(np.concatenate((heads, [len(key)])))
        heads, sizes = heads[sizes >= least], sizes[sizes >= least]
        for found, at in ((good, i[heads]), (also, (i - line)[heads])):  # stretches that are the same word for word
            change = np.bincount(at, minlength=len(found) + 1) - np.bincount(at + sizes - least + 1, minlength=len(found) + 1)
            found |= np.cumsum(change[:-1]) > 0
    for d, x, y in zip(*(v[by_size].tolist() for v in (candidates[:, 0], low, high)), strict=True):
        if good[x] or good[y]:  # what other alignments have shown of both texts is left out at the ends
            open_starts = np.flatnonzero(~(good[x : y + 1] & also[x - d : y - d + 1]))
            if not len(open_starts):
                continue
            x, y = x + int(open_starts[0]), x + int(open_starts[-1])
        if few:
            at = i[np.searchsorted(line, d - _BAND) : np.searchsorted(line, d + _BAND, "right")]
            at = np.sort(at[(at >= x) & (at < y + least)])
            if len(at) < need:
                continue
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        else:  # texts that repeat a few words over and over
            places = np.arange(x, y + least)
            same = np.zeros(len(places), bool)
            for k in range(d - _BAND, d + _BAND + 1):
                inside = slice(max(0, k - x), max(0, min(len(places), len(b) + k - x)))
                same[inside] |= a[places[inside]] == b[places[inside] - k]
            at = places[same]
        if len(at) < need:
            continue
        first, last = np.maximum(at[need - 1 :] - least + 1, x), np.minimum(at[: len(at) - need + 1], y)
        fits = first <= last
        change = np.bincount(first[fits] - x, minlength=y - x + 2) - np.bincount(last[fits] + 1 - x, minlength=y - x + 2)
        starts = np.flatnonzero(np.cumsum(change)) + x
        good[starts] = also[starts - d] = True
    return [[(x, y + passage - 1) for x, y in _stretches(np.flatnonzero(g), passage)] for g in (good, also)]


def _stretches(starts: np.ndarray, most: int = 1) -> list[tuple[int, int]]:
    """First and last of each run of numbers that are ``most`` apart at most."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > most)
    return list(zip(starts[np.concatenate(([0], cuts + 1))].tolist(), starts[np.concatenate((cuts, [len(starts) - 1]))].tolist(), strict=True))


def shared_passages(one: bytes, other: bytes, passage: int = PASSAGE) -> list[list[tuple[int, int]]]:
    """The near-duplicate passages of two texts alone: for either text disjoint runs of words (first, last)."""
    who, what, *places = marks_of([one, other], None, None, passage)
    both = np.intersect1d(what[who == 0], what[who == 1])
    sides = []
    for text in (0, 1):
        own = (who == text) & np.isin(what, both)
        sides.append((np.concatenate(([0], np.cumsum(np.unique(what[own], return_counts=True)[1]))), *(x[own] for x in places)))
    found = join_windows(np.zeros(len(both), int), both, *sides, passage)
    return verified_runs(one, other, np.column_stack(found[1:]), passage)


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def near_duplicate_passages(docs: DataFrame, text: str = "text", id: str = "doc_id", passage: int = PASSAGE) -> DataFrame:
    """id, class_id, n_links, n_copies, passages (word runs) of every document that shares a passage with another one.

    passages is the union of the runs of all verified links of the document's text, disjoint and in order. n_links
    counts those links, n_copies the other documents with its text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(whole).alias("key"), whole.alias("text"))

    def counted(rows: DataFrame) -> DataFrame:
        twin = F.xxhash64(F.lit(1), "text")  # another hash, which tells different texts of one key
        return kept(rows.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.min(twin).alias("x"), F.max(twin).alias("y")))

    copies = counted(rows)
    if clashing := [r.key for r in copies.where("x <> y").select("key").collect()]:  # some 3 in 10^10 texts
        rows = rows.withColumn("key", F.when(F.col("key").isin(clashing), F.xxhash64(F.lit(1), "text")).otherwise(F.col("key")))
        copies = counted(rows)
    copies = copies.drop("x", "y")
    repeated = may_be_in(key_filter(copies.where("n > 1"), "key"), "key")
    first = copies.select(F.col("key").alias("k"), "least")
    firsts = rows.where(repeated).join(first, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("least")), "left_semi")
    texts = rows.where(~repeated).select("key", "text").union(kept(firsts.select("key", "text").dropDuplicates(["key"])))

    groups = kept(texts.select(F.explode(min_hashes(F.col("text"), passage)).alias("hash")).groupBy("hash").count().where("count > 1"))
    few, many = key_filter(groups, "hash"), key_filter(groups.where(F.col("count") > GROUP), "hash")
    marks, path = stored(texts.select("key", F.explode(shared_marks(F.col("text"), few, many, passage)).alias("m")).select("key", "m.hash", "m.windows"))
    counts = kept(marks.groupBy("hash").count().where("count > 1"))
    members, members_path = stored(marks.where(may_be_in(key_filter(counts, "hash"), "hash")).join(counts, "hash"))
    removed(docs.sparkSession, path)
    del marks, counts
    freed(docs.sparkSession)
    small, many_of = members.where(F.col("count") <= GROUP).drop("count"), members.where(F.col("count") > GROUP)
    crowded, holders = kept(many_of.select("hash").distinct()), kept(many_of.select("key").distinct())
    wanted = key_filter(crowded, "hash")
    large = texts.where(may_be_in(key_filter(holders, "key"), "key")).select("key", F.explode(run_contexts(F.col("text"), wanted, passage)).alias("m"))
    told, path = stored(large.select("key", "m.hash", "m.context", "m.places").join(crowded, "hash", "left_semi"))
    large = kept(told.select("key", "hash", F.xxhash64("context").alias("kind"), "places"))
    kinds = told.groupBy("hash", "context").agg(F.min(F.struct("key", "places")).alias("m"))
    kinds = kept(kinds.select("hash", "context", F.xxhash64("context").alias("kind"), "m.key", "m.places"))
    removed(docs.sparkSession, path)
    ends = kinds.groupBy("hash").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    hubs = kinds.join(ends, "hash").where("key = low or key = high").groupBy("hash", "key").agg(F.min(F.struct("context", "places")).alias("m"))
    hubs = kept(hubs.select("hash", "key", "m.context", "m.places"))
    del told, ends
    freed(docs.sparkSession)

    @F.arrow_udf("struct<first:int,last:int>")
    def common(left: pa.Array, right: pa.Array) -> pa.Array:
        sides = [np.frombuffer(b"".join(x.to_pylist()), np.uint32).reshape(len(x), -1) for x in (left, right)]
        found = common_starts(*sides, passage) if len(left) else (np.empty(0, int),) * 2
        return pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in found], names=["first", "last"])

    def met(x: DataFrame, y: DataFrame, which: Column, on: tuple[str, ...] = ("hash",)) -> DataFrame:
        """a, b and the runs of both for members x and y of one mark that share a passage there."""
        other = y.select(*on, *[F.col(c).alias(f"_{c}") for c in y.columns if c not in on])
        found = x.join(other, list(on)).where(which)
        found = found.withColumn("starts", common("context" if "context" in x.columns else "_context", "_context")).where("starts.first <= starts.last")
        runs = lambda places: F.transform(places, lambda p: F.struct((p + F.col("starts.first")).alias("first"), (p + F.col("starts.last") + passage - 1).alias("last")))
        return kept(found.select(F.col("key").alias("a"), F.col("_key").alias("b"), F.struct(runs("places").alias("a"), runs("_places").alias("b")).alias("runs")))

    @F.arrow_udf(f"struct<a:{RUNS},b:{RUNS}>")
    def compared(left: pa.Array, right: pa.Array, starts: pa.Array) -> pa.Array:
        flat = starts.flatten()
        rows = np.column_stack([flat.field(c).to_numpy() for c in ("d", "first", "last")])
        each = np.split(rows, np.cumsum(starts.value_lengths().to_numpy())[:-1])
        found = [verified_runs(x, y, z, passage) for x, y, z in zip(raw_rows(left), raw_rows(right), each, strict=True)]
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], _RUN_TYPE) for k in (0, 1)], names=["a", "b"])

    def verified(members: DataFrame) -> DataFrame:
        """a, b, runs of the pairs of members of one hash that share a passage. Pairs are first counted by their functions
        alone; only those with enough are joined with their windows, and only the texts of candidates are shuffled."""
        own = members.select("hash", F.col("key").alias("a"))
        bits = own.join(own.withColumnRenamed("a", "b"), "hash").where("a < b").groupBy("a", "b").agg(F.bit_or(F.expr("shiftleft(1, cast(hash & 7 as int))")).alias("f"))
        pairs = kept(bits.where((F.bit_count("f") >= ENOUGH) | (F.col("f") >= 1 << RUN)).select("a", "b"))
        one = pairs.join(members.select(F.col("key").alias("a"), "hash", F.col("windows").alias("wa")), "a")
        both = one.join(members.select(F.col("key").alias("b"), "hash", F.col("windows").alias("wb")), ["b", "hash"])
        shared = both.groupBy("a", "b").agg(F.collect_list(F.struct("hash", F.col("wa").alias("a"), F.col("wb").alias("b"))).alias("shared"))  # of one pair of texts
        likely = kept(shared.select("a", "b", candidate_starts(F.col("shared"), passage).alias("starts")).where(F.size("starts") > 0))
        del own, bits, pairs, one, both, shared  # what the largest shuffles have written isn't read again
        freed(docs.sparkSession)
        wanted = kept(likely.select(F.col("a").alias("key")).union(likely.select("b")).distinct())
        held = kept(texts.where(may_be_in(key_filter(wanted, "key"), "key")).join(wanted, "key", "left_semi"))
        both = likely.join(held.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").join(held.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
        return kept(both.select("a", "b", compared("ta", "tb", "starts").alias("runs")).where(F.size("runs.a") > 0))

    links = verified(small)
    del small, many_of, members
    removed(docs.sparkSession, members_path)
    freed(docs.sparkSession)
    links = links.union(met(large, kinds, F.expr("key <> _key"), ("hash", "kind"))).union(met(kinds, hubs, F.expr("key <> _key")))
    classes = connected_components(links.select("a", "b").distinct())
    del large, hubs
    freed(docs.sparkSession)
    told = kept(kinds.drop("kind").join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key")))
    mixed = told.groupBy("hash").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("hash")
    apart = told.join(mixed, "hash", "left_semi").groupBy("hash", "component", "context").agg(F.min(F.struct("key", "places")).alias("m"))
    apart = kept(apart.select("hash", "component", "context", "m.key", "m.places"))
    if not apart.isEmpty():

        def contexts_in(contexts: pa.Array) -> np.ndarray:
            return np.frombuffer(b"".join(contexts.to_pylist()), np.uint32).reshape(len(contexts), -1) if len(contexts) else np.empty((0, _span(passage)), np.uint32)

        @F.arrow_udf("array<struct<k:bigint,plain:boolean,code:int>>")
        def keys_of(contexts: pa.Array, marks: pa.Array) -> pa.Array:
            at, key, plain, code = edit_keys(contexts_in(contexts), marks.to_numpy().view(np.uint64), passage)
            order = np.argsort(at, kind="stable")
            flat = pa.StructArray.from_arrays([pa.array(key[order].view(np.int64)), pa.array(plain[order]), pa.array(code[order])], names=["k", "plain", "code"])
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(at[order], np.arange(len(contexts) + 1)), pa.int32()), flat)

        @F.arrow_udf("array<struct<k:bigint,plain:boolean>>")
        def full_keys_of(contexts: pa.Array, marks: pa.Array, codes: pa.Array) -> pa.Array:
            asked = np.repeat(np.arange(len(codes)), codes.value_lengths().to_numpy())
            at, key, plain = full_keys(contexts_in(contexts), marks.to_numpy().view(np.uint64), asked, codes.flatten().to_numpy(), passage)
            order = np.argsort(at, kind="stable")
            flat = pa.StructArray.from_arrays([pa.array(key[order].view(np.int64)), pa.array(plain[order])], names=["k", "plain"])
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(at[order], np.arange(len(contexts) + 1)), pa.int32()), flat)

        several = lambda keys: keys.groupBy("k").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("plain").alias("all_plain"), F.min(F.struct("plain", "row", "component")).alias("hub")).where("x <> y and not all_plain")
        apart = kept(apart.withColumn("row", F.xxhash64("hash", "component", "context")))
        one = apart.select("row", "component", F.explode(keys_of("context", "hash")).alias("e")).select("row", "component", "e.k", "e.plain", "e.code")
        codes = one.join(several(one).select("k"), "k", "left_semi").groupBy("row").agg(F.collect_set("code").alias("codes"))  # of some hundred codes
        full = apart.join(codes, "row").select("row", "component", F.explode(full_keys_of("context", "hash", "codes")).alias("e")).select("row", "component", "e.k", "e.plain")
        full = kept(full)
        # all of a full key share a passage, so each goes with one of them that isn't plain, and no key takes its pairs
        hubs_of = several(full).select("k", F.col("hub.row").alias("_row"), F.col("hub.component").alias("_component"))
        pairs = kept(full.join(hubs_of, "k").where("component <> _component").select("row", "_row").distinct())
        rows_of = apart.drop("component")
        x = pairs.join(rows_of.drop("hash"), "row").withColumn("pair", F.xxhash64("row", "_row")).drop("row", "_row")
        y = pairs.join(rows_of.drop("hash").withColumnRenamed("row", "_row"), "_row").withColumn("pair", F.xxhash64("row", "_row")).drop("row", "_row")
        more = met(x, y, F.expr("key <> _key"), ("pair",))
        links = links.union(more)
        classes = connected_components(more.select("a", "b").distinct().union(classes.select("node", "component")))
    sides = links.select(F.col("a").alias("key"), F.col("b").alias("other"), F.col("runs.a").alias("runs")).union(links.select("b", "a", "runs.b"))

    @F.arrow_udf(RUNS)
    def united(found: pa.Array) -> pa.Array:
        return pa.array([_merged([(r["first"], r["last"]) for r in x]) for x in found.to_pylist()], _RUN_TYPE)

    spans = sides.select("key", F.explode("runs").alias("run")).groupBy("key").agg(united(F.collect_set("run")).alias("passages"))
    counts = sides.select("key", "other").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    linked = counts.join(spans, "key").join(classes.withColumnRenamed("node", "key"), "key", "left")

    @F.arrow_udf("boolean")
    def long(texts: pa.Array) -> pa.Array:
        return pa.array([len(words_of(raw)) >= passage for raw in raw_rows(texts)], pa.bool_())

    again = texts.where(repeated).join(copies.where("n > 1"), "key", "left_semi").where(long("text")).select("key", F.lit(True).alias("long"))
    known = copies.join(linked, "key", "left").join(again, "key", "left").where(F.col("component").isNotNull() | F.col("long"))
    known = kept(known.select("key", F.coalesce("component", "key").alias("class"), "least", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("n") - 1).alias("n_copies"), "passages"))
    least = kept(known.groupBy("class").agg(F.min("least").alias("class_id")))
    known = kept(known.join(least, "class").drop("class", "least"))
    return rows.select("id", "key").join(known, "key").select(F.col("id").alias(id), "class_id", "n_links", "n_copies", "passages")
