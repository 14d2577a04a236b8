"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts go through in groups of like size in bytes. For a byte-level tokenizer each text is split at boundaries that no
pre-token crosses, at lone spaces and, in long parts, after letters that a sign follows; each distinct part is encoded
once by the library, in batches of like size in bytes, and remembered for the task, at most ``REMEMBERED`` parts at a
time. Other tokenizers get whole texts.

Cases: a null text is an empty one and has 0 bytes and 0 tokens; texts of any length count whole; repeated rows give
repeated rows; an empty table gives an empty table; output columns replace columns of the same names.
"""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piperack.llm.textcut import by_bytes, safe_chunks, short_parts, text_rows

#: Part counts that a task remembers before it starts anew, bytes in a batch for the library, and the characters from which a part is cut.
REMEMBERED, BATCH, LONG = 300_000, 1 << 16, 1 << 15


class Counter:
    """Counts tokens as the library of the given vocabulary file does, special strings included, without added ones."""

    def __init__(self, name: str, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.lengths = self._sentencepiece(content) if name.endswith(".model") else self._tokenizers(content)
        spec = json.loads(content) if name.endswith(".json") else {}
        self.split = bool(spec) and self._splits(spec)
        contents = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.specials = re.compile(f"({'|'.join(contents)})") if contents else None
        self.leading: dict[str, int] = {}
        self.spaced: dict[str, int] = {}

    @staticmethod
    def _splits(spec: dict) -> bool:
        """If a lone space always starts a pre-token: byte-level pattern, nothing rewritten, no special string with a space."""
        cut = spec.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        own = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
        return bool(plain and own and not spec.get("normalizer"))

    @staticmethod
    def _tokenizers(content: bytes):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _sentencepiece(content: bytes):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]

    def _learn(self, cache: dict[str, int], wanted: list[str], lead: str) -> None:
        new = [w for w in dict.fromkeys(wanted) if w not in cache]
        long = [w for w in new if len(w) > LONG]
        new = [w for w in new if len(w) <= LONG]
        at = 0
        for group in by_bytes([lead + w for w in new], BATCH):
            cache.update(zip(new[at : at + len(group)], self.lengths(group), strict=True))
            at += len(group)
        for w in long:
            cache[w] = sum(n for group in by_bytes(short_parts(lead + w, self.specials, LONG), BATCH) for n in self.lengths(group))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text of a group."""
        if not self.split:
            return self.lengths(texts)
        if len(self.spaced) + len(self.leading) > REMEMBERED:
            self.leading.clear()
            self.spaced.clear()
        cut = [safe_chunks(t) for t in texts]
        self._learn(self.leading, [c[0] for c in cut], "")
        get, gaps, found = self.spaced.get, [], []
        for _, *rest in cut:
            found.append(n := [get(c) for c in rest])
            if None in n:
                gaps += [c for c, k in zip(rest, n, strict=True) if k is None]
        if gaps:
            self._learn(self.spaced, gaps, " ")
        return [self.leading[c[0]] + (sum(map(get, c[1:])) if None in n else sum(n)) for c, n in zip(cut, found, strict=True)]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more tokens than ``limit``) of every whole text."""
    name = os.path.basename(path)
    with open(path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, of one size whatever the data

    own: list[Counter] = []  # a task has its own copy of this list, and what is in it goes with the task

    @F.arrow_udf("long")
    def lengths(texts: pa.Array) -> pa.Array:
        if not own:
            own.append(Counter(name, vocabulary.value))
        return pa.array([n for group in by_bytes(text_rows(texts)) for n in own[0].count(group)], pa.int64())

    whole = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumn("n_tokens", lengths(whole)).withColumn("n_bytes", F.octet_length(whole).cast("long"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
