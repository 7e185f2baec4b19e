"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ORDER bytes with the counts of what followed. A byte seen in the longest
context costs -log2 of n / (total + kinds); one unseen costs the escape, kinds / (total + kinds), and is coded in the
next shorter context, down to even odds for all 256 (method C, without exclusions). Counts are frozen after training,
so a text's exact code length is a sum of table look-ups; the language with the shortest code wins.

Trees are counted on a bounded hash sample of labelled documents, whole texts: DOCS_PER_LANGUAGE. Every language and every context of
the sample is kept. Languages come in blocks of BLOCK_LANGUAGES; a block's look-up table has a row for each context that one of
its languages has, so the tables grow as the contexts of all languages do.

Defined results: a text that is null or has no letter is `und` with score 0; without any training document all are
`und`; ties go to the first language by code point; a null doc_id is held in; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.llm.common import materialise
from chronofact.shipping import ship

ORDER = 4
DOCS_PER_LANGUAGE = 1_500
BLOCK_LANGUAGES = 16
#: What stands before a text's first byte.
_BEFORE = b"\n" * ORDER


def grams(raw: bytes, before: bytes = _BEFORE) -> np.ndarray:
    """For each byte, the ORDER bytes before it and itself as one number."""
    b = np.frombuffer(before + raw, np.uint8).astype(np.uint64)
    n, out = len(raw), np.zeros(len(raw), np.uint64)
    for i in range(ORDER + 1):
        out = (out << np.uint64(8)) | b[i : i + n]
    return out


def blocks(raw: bytes, size: int = 1 << 18) -> Iterator[np.ndarray]:
    """The grams of a text, some at a time."""
    for a in range(0, len(raw), size):
        yield grams(raw[a : a + size], (_BEFORE + raw[max(0, a - ORDER) : a])[-ORDER:] if a else _BEFORE)


class ContextTrees:
    """Frozen code lengths. costs[k]: for each (k + 1)-gram seen in any language, bits per language; escapes[k]: bits to leave a k-byte context."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.names = sorted(counts)
        self.codes, self.costs, self.contexts, self.escapes = [], [], [], []
        for k in range(ORDER + 1):
            per = []
            for name in self.names:
                code, n = counts[name]
                own, back = np.unique(code & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
                per.append((own, np.bincount(back, weights=n)))
            codes = np.unique(np.concatenate([own for own, _ in per]))
            contexts = np.unique(codes >> np.uint64(8))
            costs, escapes = np.zeros((len(codes), len(self.names)), np.float32), np.zeros((len(contexts), len(self.names)), np.float32)
            lower = self._lookup(codes & np.uint64((1 << 8 * k) - 1), k - 1) if k else np.full((len(codes), len(self.names)), 8.0)
            at = np.searchsorted(contexts, codes >> np.uint64(8))
            for j, (own, n) in enumerate(per):
                seen, count = np.searchsorted(codes, own), np.zeros(len(codes))
                count[seen] = n
                total, kinds = np.bincount(at, weights=count, minlength=len(contexts)), np.bincount(at, weights=count > 0, minlength=len(contexts))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escapes[:, j] = np.where(total > 0, np.log2((total + kinds) / kinds), 0)
                    costs[:, j] = np.where(count > 0, np.log2((total + kinds)[at] / count), escapes[at, j] + lower[:, j])
            self.codes.append(codes)
            self.costs.append(costs)
            self.contexts.append(contexts)
            self.escapes.append(escapes)

    def _lookup(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Bits of each (k + 1)-gram per language."""
        if k < 0:
            return np.full((len(codes), len(self.names)), 8.0, np.float32)
        at = np.minimum(np.searchsorted(self.codes[k], codes), len(self.codes[k]) - 1)
        out = self.costs[k][at]
        missed = np.flatnonzero(self.codes[k][at] != codes)
        if len(missed):
            rest = codes[missed]
            context = np.minimum(np.searchsorted(self.contexts[k], rest >> np.uint64(8)), len(self.contexts[k]) - 1)
            known = self.contexts[k][context] == rest >> np.uint64(8)
            out[missed] = self._lookup(rest & np.uint64((1 << 8 * k) - 1), k - 1) + np.where(known[:, None], self.escapes[k][context], 0)
        return out

    def code_lengths(self, texts: list[bytes], block: int = 1 << 18) -> np.ndarray:
        """Bits of each text per language."""
        out = np.zeros((len(texts), len(self.names)))
        codes, owners, held = [], [], 0

        def settle() -> None:
            starts = np.cumsum([0, *[len(c) for c in codes[:-1]]])
            np.add.at(out, owners, np.add.reduceat(self._lookup(np.concatenate(codes), ORDER), starts, axis=0, dtype=np.float64))
            codes.clear(), owners.clear()

        for i, raw in enumerate(texts):
            for own in blocks(raw, block):
                codes.append(own)
                owners.append(i)
                held += len(own)
                if held >= block:
                    settle()
                    held = 0
        if codes:
            settle()
        return out


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, block_languages: int = BLOCK_LANGUAGES) -> list[ContextTrees]:
    """Trees, in blocks of languages, from the documents that aren't held out and have a language."""
    ship(docs.sparkSession)
    known = docs.filter(~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("__t")).filter("__lang is not null and __t is not null and __t <> ''")
    sizes = materialise(known.groupBy("__lang").agg(F.count(F.lit(1)).alias("__n")))
    draw = F.pmod(F.xxhash64(F.lit(11), "__id", "__t"), F.lit(1 << 30))

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}

        def settled(name: str) -> pd.DataFrame:
            code, n = np.unique(np.concatenate(held.pop(name)), return_counts=True)
            return pd.DataFrame({"__lang": name, "__code": code.astype("int64"), "__n": n})

        for part in parts:
            for name, text in zip(part["__lang"], part["__t"], strict=True):
                for some in blocks(text.encode("utf-8", "surrogatepass")):
                    own = held.setdefault(name, [])
                    own.append(some)
                    if sum(map(len, own)) >= 1 << 20:
                        yield settled(name)
            for name in [*held]:
                yield settled(name)

    sample = known.join(F.broadcast(sizes), "__lang").filter(draw * F.col("__n") < F.lit(docs_per_language << 30)).select("__lang", "__t")
    total = sample.mapInPandas(counted, "__lang string, __code bigint, __n bigint").groupBy("__lang", "__code").agg(F.sum("__n").alias("__n"))
    total = total.orderBy("__lang").toArrow().to_pandas()
    counts = {name: (own["__code"].to_numpy().astype(np.uint64), own["__n"].to_numpy().astype(float)) for name, own in total.groupby("__lang")}
    names = sorted(counts)
    return [ContextTrees({name: counts[name] for name in names[a : a + block_languages]}) for a in range(0, len(names), block_languages)]


def predict(docs: DataFrame, trees: list[ContextTrees], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (the posterior of the language under even priors)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    names = np.array([name for tree in trees for name in tree.names], dtype=object)

    @F.pandas_udf("lang string, score double")
    def best(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in parts:
            lang, sure = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            there = [i for i, t in enumerate(texts) if own and t is not None and any(map(str.isalpha, t))]
            if there:
                values = texts.to_list()
                raw = [values[i].encode("utf-8", "surrogatepass") for i in there]
                bits = np.hstack([tree.code_lengths(raw) for tree in own])
                first = bits.argmin(1)
                odds = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000))
                lang[there] = names[first]
                sure[there] = 1 / odds.sum(1)
            yield pd.DataFrame({"lang": lang, "score": sure})

    out = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), best(F.col(text_col)).alias("__best"))
    return out.select("doc_id", "held_out", F.col("__best.lang").alias("lang_pred"), F.col("__best.score").alias("score"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options: int) -> DataFrame:
    """Train on what isn't held out and predict every document."""
    return predict(docs, train(docs, id_col, text_col, lang_col, **options), id_col, text_col)
