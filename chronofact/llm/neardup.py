"""Near-deduplication by exact Jaccard likeness of word shingles: a prefix-filtered join whose pairs are all verified.

With a `radius`, SimHash comes first: documents whose fingerprints lie within it are linked, by the multi-index hashing of `simhash`. These
links miss nearly all pairs that share just four fifths of their shingles; the join begins with their components and adds every pair of the likeness.

A document is the set of its w-word shingles (words as in `simhash`, 64-bit hashes). Two sets of likeness 0.8 or more share a
shingle of their prefixes: the first n - ceil(0.8 n) + 1 of n shingles in an order that is the same for all documents. Any
order gives the same pairs; shingles that a sample of documents has often come last, so that few documents meet. Two sets of m and n
shingles have the likeness if they share at least 4 (m + n) / 9. Where they meet first, none of the shingles before is common, so
each must have that many from there on: at that shingle, and only there need it be so, both places are early enough (`may_meet`).

Pairs are first held against bitmaps of the sets, which bound the common shingles from above; whole sets are compared only for the
pairs that may have the likeness. Documents with equal sets are one node. Prefix shingles of at most SMALL nodes give all their pairs that may meet. Under
crowded ones, nodes whose place lets them meet no size there are left out; a few rounds compare each node with one pivot a shingle, first the one
with the fewest shingles before, and follow the components; shingles whose nodes are all in one component are done, for their pairs can
link nothing more. In those left, each node outside the shingle's largest component is compared with every node of another component
that it may meet. So the components are those of all pairs, and a large group of near copies costs a multiple of its rows, unless
many of its members come close to the likeness without having it.

Defined results: a null text equals an empty one; texts without words are one node; fewer words than a shingle make one
shingle; a null doc_id is the smallest id; of repeated rows one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.llm.common import BitFilter, by_slices, id_of, join_by_key, materialise, text_of, weights, whole_row
from chronofact.llm.simhash import SEGMENTS, components, fingerprint, grouped, shingle_hashes

#: Likeness as a fraction, so that comparisons are whole numbers.
NUM, DEN = 4, 5
#: Documents sampled for the order of shingles, and shingles that the order tells apart; neither changes the result.
SAMPLE, FREQUENT = 20_000, 100_000
#: Nodes under a prefix shingle of which all pairs are made; rounds of pivots for larger ones.
SMALL, ROUNDS = 32, 4


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words).view(np.int64))


def prefix(s: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The prefix of a sorted set in the order (count in the sample, hash); hashes are sorted."""
    n = len(s) - (NUM * len(s) + DEN - 1) // DEN + 1 if len(s) else 0
    if not len(hashes):
        return s[:n]
    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
    return s[np.lexsort((s, np.where(hashes[at] == s, counts[at], 0)))[:n]]


def bitmap(s: np.ndarray) -> bytes:
    """Bits of the hashes modulo a power of two of at least twice their number; the upper half or-ed to the lower is that of half the width."""
    width = 1 << max(6, (2 * len(s) - 1).bit_length() if len(s) else 0)
    bits = np.zeros(width, np.uint8)
    bits[s & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_share(a: bytes, b: bytes, m: int, n: int) -> bool:
    """Whether sets of these bitmaps and sizes can have the likeness: a bit that the other lacks is a shingle that it lacks."""
    x, y, wide, narrow = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(a), len(b)
    while wide > narrow:
        wide //= 2
        x = (x >> 8 * wide) | (x & ((1 << 8 * wide) - 1))
    while narrow > wide:
        narrow //= 2
        y = (y >> 8 * narrow) | (y & ((1 << 8 * narrow) - 1))
    return (NUM + DEN) * min(m - (x & ~y).bit_count(), n - (y & ~x).bit_count()) >= NUM * (m + n)


def with_set(df: DataFrame, text_col: str, out: str, words: int) -> DataFrame:
    return by_slices(df, text_col, f"{out} array<bigint>", lambda texts: [[shingle_set(t, words) for t in texts]])


def frequent(rows: DataFrame, total: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of about FREQUENT shingles that a sample of documents has most often, sorted by hash. The driver sees how many have each count, and those."""
    some = rows.filter(F.pmod(F.xxhash64("__id", "__th"), F.lit(max(1, total // SAMPLE))) == 0)
    each = with_set(some, "__t", "__s", words).select(F.explode("__s").alias("__key")).groupBy("__key").agg(F.count(F.lit(1)).alias("__c"))
    each = materialise(each.filter("__c > 1"))
    least, part, room = 2, 1 << 20, FREQUENT
    for c, n in each.groupBy("__c").agg(F.count(F.lit(1)).alias("__k")).orderBy(F.desc("__c")).collect():
        if n > room:  # of these, a share by hash
            least, part = c, (room << 20) // n
            break
        room -= n
    top = each.filter((F.col("__c") > least) | ((F.col("__c") == least) & (F.pmod(F.xxhash64("__key"), F.lit(1 << 20)) < part))).toArrow()
    hashes, counts = top["__key"].to_numpy(), top["__c"].to_numpy()
    at = np.argsort(hashes)
    return hashes[at], counts[at]


def with_prefix(rows: DataFrame, order: tuple[np.ndarray, np.ndarray], words: int, prints: bool) -> DataFrame:
    """rows with __fp (hash of the set), __n (its size), __prefix, __bits and __sim (SimHash fingerprint, null without `prints`)."""
    shared = rows.sparkSession.sparkContext.broadcast(order)

    def prefixes(texts: list[str | None]) -> list[list]:
        sets = [shingle_set(t, words) for t in texts]
        nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
        return [nodes, list(map(len, sets)), [prefix(s, *shared.value) for s in sets], [bitmap(s) for s in sets], list(map(fingerprint, texts)) if prints else [None] * len(texts)]

    return by_slices(rows, "__t", "__fp bigint, __n int, __prefix array<bigint>, __bits binary, __sim bigint", prefixes)


def may_meet(m: Column, p: Column, n: Column, q: Column) -> Column:
    """Whether sets of sizes m and n can have the likeness if their first common shingle is at places p and q, from 0."""
    return (NUM + DEN) * F.least(m - p, n - q) >= NUM * (m + n)


def alike(found: DataFrame, radius: int, segments: int) -> DataFrame:
    """(__a, __b): sets, connecting all that have documents whose fingerprints are connected within `radius` bits. found: __fp, __sim."""
    rows = materialise(found.select(F.col("__fp").alias("__id"), F.lit(0).cast("bigint").alias("__th"), F.col("__sim").alias("__fp")).distinct())
    groups = grouped(rows, radius, segments)
    total, most = weights(groups, "__n")
    met = join_by_key(rows, groups, ["__fp"], "__n", total, F.col("__id"), most)
    return materialise(met.select(F.col("__best.__id").alias("__a"), F.col("__id").alias("__b")).filter("__a <> __b").distinct())


def sets_of(named: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(__fp, __s): the whole sets of the nodes in named (__fp), without repeats. nodes: __fp, __id, __th; docs: __id, __th, __t."""
    named = materialise(nodes.join(named, "__fp", "left_semi").select("__fp", "__id", "__th"))
    row = F.xxhash64("__id", "__th")
    texts = BitFilter.of(named, row, named.count()).mark(docs, row, "__in").filter("__in").select("__id", "__th", "__t")
    texts = texts.join(named, ["__id", "__th"]).dropDuplicates(["__fp"])
    return materialise(with_set(texts, "__t", "__s", words).select("__fp", "__s"))


def verified(pairs: DataFrame, nodes: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs (__a, __b) whose sets have the likeness. nodes: __fp, __n, __bits; sets: gives (__fp, __s) of all in the pairs that it gets."""
    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([may_share(*x) for x in zip(a, b, m.tolist(), n.tolist(), strict=True)], dtype=bool)

    side = lambda x: nodes.select(F.col("__fp").alias(f"__{x}"), F.col("__n").alias(f"__n{x}"), F.col("__bits").alias(f"__bits{x}"))
    pairs = pairs.join(side("a"), "__a").join(side("b"), "__b").filter(may("__bitsa", "__bitsb", "__na", "__nb")).select("__a", "__b")
    pairs = materialise(pairs)
    if not pairs.take(1):
        return pairs
    found = sets(pairs)
    both = pairs.join(found.select(F.col("__fp").alias("__a"), F.col("__s").alias("__sa")), "__a").join(found.select(F.col("__fp").alias("__b"), F.col("__s").alias("__sb")), "__b")
    common = F.size(F.array_intersect("__sa", "__sb"))
    return materialise(both.filter((NUM + DEN) * common >= NUM * (F.size("__sa") + F.size("__sb"))).select("__a", "__b"))


def _pairs(one: Column, other: Column) -> list[Column]:
    return [F.least(one, other).alias("__a"), F.greatest(one, other).alias("__b")]


def linked(nodes: DataFrame, docs: DataFrame, words: int, known: DataFrame | None = None) -> DataFrame:
    """(__fp, __root): the components that all pairs of nodes of the likeness make, with the links known, if any. nodes: __fp, __id, __th, __n, __prefix, __bits."""
    keys = nodes.select(F.posexplode("__prefix").alias("__p", "__key"), "__fp", "__n")
    met = materialise(keys.groupBy("__key").agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1"))
    total, _ = weights(met, "__c")
    members = materialise(join_by_key(keys, met, ["__key"], "__c", total, F.col("__fp")).filter("__c IS NOT NULL"))
    lists = members.filter(F.col("__c") <= SMALL).groupBy("__key").agg(F.collect_list(F.struct("__fp", "__n", "__p")).alias("__m"))
    ones = lists.select("__m", F.explode("__m").alias("__x")).select("__x", F.explode("__m").alias("__y"))
    meet = may_meet(F.col("__x.__n"), F.col("__x.__p"), F.col("__y.__n"), F.col("__y.__p"))
    small = ones.filter((F.col("__x.__fp") < F.col("__y.__fp")) & meet).select(F.col("__x.__fp").alias("__a"), F.col("__y.__fp").alias("__b"))
    of_pairs = lambda p: sets_of(p.select(F.explode(F.array("__a", "__b")).alias("__fp")).distinct(), nodes, docs, words)
    edges = verified(small.distinct(), nodes, of_pairs)
    if known is not None:
        edges = materialise(known.unionByName(edges))
    labels = components(edges)
    crowd, weight = _unsettled(_with_company(members.filter(F.col("__c") > SMALL)), labels)
    named = crowd.select("__fp").distinct()
    of_crowd = cache(lambda: sets_of(named, nodes, docs, words))  # texts are read once for all rounds
    for i in range(ROUNDS + 1):
        if not weight[0]:
            break
        if i < ROUNDS:
            pivot = crowd.groupBy("__key").agg(F.count(F.lit(1)).alias("__c"), F.min_by(F.struct("__fp", "__n", "__p", "__root"), F.struct(F.col("__p") if i == 0 else F.lit(0), F.xxhash64("__fp", F.lit(i)))).alias("__y"))
            both = join_by_key(crowd, materialise(pivot), ["__key"], "__c", weight[0], F.col("__fp"), weight[1])
            found = both.filter((F.col("__root") != F.col("__y.__root")) & may_meet(F.col("__n"), F.col("__p"), F.col("__y.__n"), F.col("__y.__p"))).select(*_pairs(F.col("__fp"), F.col("__y.__fp")))
        else:  # every pair that could still link components
            sizes = crowd.groupBy("__key", "__root").agg(F.count(F.lit(1)).alias("__k"))
            largest = materialise(sizes.groupBy("__key").agg(F.max_by("__root", F.struct("__k", "__root")).alias("__most"), F.sum("__k").alias("__c")))
            outside = join_by_key(crowd, largest, ["__key"], "__c", weight[0], F.col("__fp"), weight[1]).filter(F.col("__root") != F.col("__most"))
            outside = materialise(outside.select("__key", F.col("__fp").alias("__y"), F.col("__n").alias("__yn"), F.col("__p").alias("__yp"), F.col("__root").alias("__yr")))
            both = crowd.join(outside, "__key").filter((F.col("__root") != F.col("__yr")) & may_meet(F.col("__n"), F.col("__p"), F.col("__yn"), F.col("__yp")))
            found = both.select(*_pairs(F.col("__fp"), F.col("__y")))
        new = verified(found.distinct(), nodes, lambda p: of_crowd())
        if new.take(1):
            edges = materialise(edges.unionByName(new))
            labels = components(edges, labels)
            if i < ROUNDS:
                crowd, weight = _unsettled(crowd, labels)
    return labels


def _with_company(crowd: DataFrame) -> DataFrame:
    """The rows of crowd whose place lets them meet any size under their shingle, by the earliest place of that size."""
    sizes = crowd.groupBy("__key", "__n").agg(F.min("__p").alias("__p"), F.count(F.lit(1)).alias("__c"))
    sizes = materialise(sizes.groupBy("__key").agg(F.collect_list(F.struct("__n", "__p")).alias("__sizes"), F.sum("__c").alias("__c")))
    total, most = weights(sizes, "__c")
    met = join_by_key(crowd.select("__key", "__fp", "__n", "__p"), sizes, ["__key"], "__c", total, F.col("__fp"), most)
    return materialise(met.filter(F.exists("__sizes", lambda x: may_meet(F.col("__n"), F.col("__p"), x["__n"], x["__p"]))).select("__key", "__fp", "__n", "__p"))


def _unsettled(crowd: DataFrame, labels: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """crowd's rows under shingles whose nodes are in several components, with __root; and how many those are, in all and under one shingle."""
    rooted = crowd.drop("__root").join(labels, "__fp", "left").withColumn("__root", F.coalesce("__root", "__fp"))
    rooted = materialise(rooted.select("__key", "__fp", "__n", "__p", "__root"))
    keys = materialise(rooted.groupBy("__key").agg(F.count(F.lit(1)).alias("__c"), (F.min("__root") != F.max("__root")).alias("__open")))
    total, most = weights(keys, "__c")
    left = materialise(join_by_key(rooted, keys, ["__key"], "__c", total, F.col("__fp"), most).filter("__open").drop("__c", "__open"))
    return left, weights(keys.filter("__open"), "__c")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int | None = None, segments: int = SEGMENTS) -> DataFrame:
    """The document with the smallest id of each component, with all columns of `docs`. With a radius, fingerprints within it link documents too."""
    rows = docs.select(whole_row(docs).alias("__row"), id_of(id_col).alias("__id"), F.xxhash64(text_of(text_col)).alias("__th"), text_of(text_col).alias("__t"))
    texts = rows.select("__id", "__th", "__t")
    found = materialise(with_prefix(texts, frequent(texts, docs.count(), words), words, radius is not None))
    nodes = materialise(found.groupBy("__fp").agg(F.min(F.struct("__id", "__th", "__n", "__prefix", "__bits")).alias("__f")).select("__fp", "__f.*"))
    rooted = nodes.join(linked(nodes, texts, words, None if radius is None else alike(found, radius, segments)), "__fp", "left").withColumn("__root", F.coalesce("__root", "__fp"))
    best = rooted.groupBy("__root").agg(F.min(F.struct("__id", "__th")).alias("__best"))
    # Nearly all rows stay where they are: only those that may be dropped, or repeated, meet the ones that are kept.
    keep = materialise(best.select("__best.*"))
    each = found.groupBy("__id", "__th").agg(F.count(F.lit(1)).alias("__c"))
    moved = materialise(each.join(keep.withColumn("__kept", F.lit(True)), ["__id", "__th"], "left").filter("__kept IS NULL OR __c > 1").select("__id", "__th", "__kept"))
    row = F.xxhash64("__id", "__th")
    rows = BitFilter.of(moved, row, moved.count()).mark(rows.drop("__t"), row, "__maybe")
    met = rows.filter("__maybe").join(moved.withColumn("__moved", F.lit(True)), ["__id", "__th"], "left")
    once = met.filter("__moved IS NULL OR __kept").dropDuplicates(["__id", "__th"])  # a row that isn't in moved is there once
    return rows.filter("not __maybe").select("__row.*").unionByName(once.select("__row.*"))
