"""Packing by first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

A document is tokenised and cut at multiples of the sequence length; full pieces are sequences of their own, and the
remainders of a group are packed, longest first, into the leftmost sequence with room, found by descending a tree that holds the
largest room of each half. Groups are drawn by a hash of the id, the text and the row's number, so that neither null ids nor repeated rows
gather in one; they are of a bounded number of documents and independent of each other. The number follows how rows are dealt to tasks and is
written down with the pieces, so that a lost task draws no other groups. Only pieces' places and lengths are shuffled, never ids.

Defined results: a null text is empty, its one id the end of the document; a null doc_id is the smallest id; repeated
rows are packed one by one; ties in length go by id, then start; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm.common import by_slices, id_of, materialise, text_of
from chronofact.shipping import ship

SEQUENCE = 4096
END_ID = 2
GROUP_DOCS = 5_000
#: Words whose ids a worker remembers, in two generations: when one is full, the one before it is forgotten.
KNOWN_WORDS = 200_000
#: The tokenizer's byte alphabet: printable bytes stand for themselves, the others for code points from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PRINTABLE))}

#: The steps before the model for which words can be looked up on their own.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_tokenizers: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """A tokenizer whose ids are looked up by word where its file says that it drops white space and joins nothing across it; else texts are encoded whole.

    Words of letters alone go to the BPE model at once, others through the whole tokenizer. Encoded ids are
    little-endian unsigned 32-bit bytes.
    """

    remembered = KNOWN_WORDS

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole, self.known, self.before = Tokenizer.from_file(path), {}, {}
        self.model, says = self.whole.model, json.loads(self.whole.to_str())
        self.by_word = says["normalizer"] == _NORMALIZER and says["pre_tokenizer"] == _PRE_TOKENIZER and says["model"]["type"] == "BPE" and not any(t["content"].split() != [t["content"]] for t in says["added_tokens"])

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]

    def _ids(self, word: str) -> bytes:
        known = self.known.get(word)
        if known is not None:
            return known
        if (known := self.before.get(word)) is not None:
            return self._keep(word, known)
        small = word.lower()
        if small.isalpha() and "Σ" not in word and unicodedata.is_normalized("NFC", word):
            if small != word:
                ids = self._ids(small)
            else:
                ids = np.array([t.id for t in self.model.tokenize("".join(map(_BYTE_CHARS.__getitem__, word.encode())))], "<u4").tobytes()
        elif len(word) > 2 and word[-1] in ".," and word[:-1].isalpha():
            ids = self._ids(word[:-1]) + self._ids(word[-1])
        else:
            ids = np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return self._keep(word, ids)

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(self.known) >= self.remembered:
            self.known, self.before = {}, self.known
        if len(word) <= 64:
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.replace("\n", " ").split(" ")
        get, found = self.known.get, None
        found = [get(w) for w in words]
        if None in found:
            found = [self._ids(w) if x is None else x for w, x in zip(words, found, strict=True)]
        return b"".join(found)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, __id, __draw, tokens and the pieces' start and crc as arrays."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(texts: list[str]) -> list[list]:
        tokenizer, out = WordTokenizer.of(tokenizer_path), ([], [], [])
        for text in texts:
            ids = tokenizer.encode(text) + end
            starts = range(0, len(ids), 4 * length)
            for to, x in zip(out, ([a // 4 for a in starts], [zlib.crc32(ids[a : a + 4 * length]) for a in starts], len(ids) // 4), strict=True):
                to.append(x)
        return [*out]

    rows = docs.select(F.col(id_col).alias("doc_id"), id_of(id_col).alias("__id"), text_of(text_col).alias("__t"))
    rows = rows.select("doc_id", "__id", F.xxhash64("__id", F.xxhash64("__t"), F.monotonically_increasing_id(), F.lit(29)).alias("__draw"), "__t")
    return by_slices(rows, "__t", "start array<bigint>, crc array<bigint>, tokens bigint", cut)


class RoomTree:
    """Tournament tree: each node holds the largest room below it, so the leftmost bin with room is found from the top."""

    def __init__(self, bins: int, room: int) -> None:
        self.size = 1 << max(0, (max(bins, 1) - 1).bit_length())
        self.room = [room] * (2 * self.size)

    def take(self, length: int) -> int:
        """Place `length` in the leftmost bin with room; the bin."""
        room, at = self.room, 1
        while at < self.size:
            at *= 2
            if room[at] < length:
                at += 1
        room[at] -= length
        found = at - self.size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; lengths are at most the capacity. Ties keep their order."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    tree, bins, offsets, used = RoomTree(len(lengths), capacity), [0] * len(lengths), [0] * len(lengths), {}
    for i in order:
        b = tree.take(lengths[i])
        bins[i], offsets[i] = b, used.get(b, 0)
        used[b] = offsets[i] + lengths[i]
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    cut = materialise(pieces(docs, tokenizer_path, id_col, text_col, length, end_id))
    groups = max(1, -(-cut.count() // group_docs))
    cut = cut.select("doc_id", "__id", F.pmod("__draw", F.lit(groups)).alias("__group"), F.col("tokens").alias("doc_tokens"), F.explode(F.arrays_zip("start", "crc")).alias("__p"))
    cut = cut.select("doc_id", "__id", "__group", "doc_tokens", F.col("__p.start").alias("start"), F.col("__p.crc").alias("ids_crc32"))
    cut = cut.withColumn("length", F.least(F.lit(length).cast("bigint"), F.col("doc_tokens") - F.col("start")))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["__id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(group["length"].tolist(), length)
        group["sequence_id"] = (int(group["__group"].iloc[0]) << 32) + np.array(bins, "int64")
        group["offset"] = np.array(offsets, "int64")
        return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    kind = docs.schema[id_col].dataType.simpleString()
    return cut.groupBy("__group").applyInPandas(packed, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
