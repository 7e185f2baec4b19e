"""SimHash near-deduplication by multi-index hashing.

Fingerprints of w-word shingles are 64 bits, cut into `segments` segments with a table each, keyed by (segment, code). With
radius r = m q + a over m segments, fingerprints within r bits differ by at most q bits in one of the first a + 1 segments or by
at most q - 1 in one of the others (for 2 bits and two segments of 32: 1 bit in the first, or none in the second). So each
fingerprint probes the tables with the ball of that radius in each segment, fetches the fingerprints found there, and
the complete distance is verified. Of two codes in each other's balls the one with fewer bits probes, or the smaller one: half the ball.

A code that more than CROWDED fingerprints share would bring too many pairs together. Those that own or probe such a code
meet by their whole codes instead, each with the ball of half the radius around its whole fingerprint: any two within the radius share
such a code, whatever meets under one is within the radius of its least fingerprint, and only links to that are kept. That
is exact, and linear in the rows. The links connect exactly what all pairs within the radius connect. Components
follow by passing on minima with pointer jumping.

Defined results: a null text equals an empty one; a text without words has fingerprint zero, linked like any other; fewer
words than a shingle make one shingle; equal fingerprints are one node; a null doc_id is the smallest id; repeated rows
are all returned by `near_duplicates`, and one of them by `drop_near_duplicates`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.llm.common import NULL_ID, id_of, join_by_key, materialise, text_of, weights, whole_row
from chronofact.shipping import ship

SEED = 42
BITS = 64
RADIUS, SEGMENTS = 2, 2
#: Fingerprints under a segment's code of which all pairs are verified.
CROWDED = 32


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of all shingles in order, as unsigned 64 bits. Byte strings split and lower-case by ASCII rules alone."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, "<u8")
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    first = np.concatenate(([0], ends[: n - 1]))
    last = ends[min(words, len(parts)) - 1 :][:n] - 1
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    return np.fromiter((digest(view[a:b], SEED) for a, b in zip(first.tolist(), last.tolist(), strict=True)), "<u8", n)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit fingerprint. Byte strings split and lower-case by ASCII rules alone."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    first = np.concatenate(([0], ends[: n - 1]))
    last = ends[min(words, len(parts)) - 1 :][:n] - 1
    digest = xxhash.xxh64_intdigest
    ones, view = np.zeros(64, np.int64), memoryview(joined)
    for at in range(0, n, 65536):
        h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(first[at : at + 65536].tolist(), last[at : at + 65536].tolist(), strict=True)), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str, out: str, words: int = 3) -> DataFrame:
    ship(docs.sparkSession)
    @F.pandas_udf("bigint")
    def prints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.withColumn(out, prints(text_of(text_col)))


def _ball(bits: int, radius: int) -> list[int]:
    """All patterns of at most `radius` of the lowest `bits` bits."""
    return [sum(1 << i for i in some) for r in range(radius + 1) for some in combinations(range(bits), r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def cuts(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius of the ball) of each segment; a segment whose ball is void is left out."""
    q, a = divmod(radius, segments)
    ends = [BITS * i // segments for i in range(segments + 1)]
    return [(ends[i], ends[i + 1] - ends[i], q if i <= a else q - 1) for i in range(segments) if i <= a or q > 0]


def _half_ball(code: Column, bits: int, radius: int) -> Column:
    """The codes within the radius that have more bits than `code`, or as many and are no smaller; `code` is one."""
    near = F.transform(F.array(*[F.lit(_signed(x)).cast("bigint") for x in _ball(bits, radius)]), lambda x: code.bitwiseXOR(x))
    return F.filter(near, lambda x: (F.bit_count(x) > F.bit_count(code)) | ((F.bit_count(x) == F.bit_count(code)) & (x >= code)))


def tables(prints: DataFrame, radius: int, segments: int) -> tuple[DataFrame, DataFrame]:
    """(__fp, __seg, __code) of the tables, one row for each segment; and the probes: those and the half balls around them."""
    numbered = lambda codes, i: F.transform(codes, lambda x: F.struct(F.lit(i).alias("__seg"), x.alias("__code")))
    own, probes = [], []
    for i, (first, bits, reach) in enumerate(cuts(radius, segments)):
        code = F.call_function("shiftrightunsigned", F.col("__fp"), F.lit(first)).bitwiseAND(F.lit(_signed((1 << bits) - 1)).cast("bigint"))
        own.append(numbered(F.array(code), i))
        probes.append(numbered(_half_ball(code, bits, reach), i))
    exploded = lambda codes: prints.select("__fp", F.explode(F.concat(*codes)).alias("__k")).select("__fp", "__k.*")
    return exploded(own), exploded(probes)


def within(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def met_whole(prints: DataFrame, radius: int) -> DataFrame:
    """(__a, __b) connecting all that are within the radius, by the ball of half of it around whole fingerprints."""
    reach = (radius + 1) // 2
    ball = F.array(*[F.lit(_signed(x)).cast("bigint") for x in _ball(BITS, reach)])
    codes = prints.select("__fp", F.explode(F.transform(ball, lambda x: F.col("__fp").bitwiseXOR(x))).alias("__code"))
    inner = F.when(F.bit_count(F.col("__fp").bitwiseXOR(F.col("__code"))) <= radius // 2, F.col("__fp"))
    # A code's least fingerprint within the lesser half is within the radius of all others; there are at most as many as the ball holds.
    met = codes.groupBy("__code").agg(F.min(inner).alias("__b"), F.collect_list("__fp").alias("__met")).filter(F.size("__met") > 1)
    return met.select("__b", F.explode("__met").alias("__a")).filter("__a <> __b").select("__a", "__b")


def links(prints: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, crowded: int = CROWDED) -> DataFrame:
    """prints: one column __fp, without repeats. (__a, __b): fingerprints within `radius` bits, connecting all that are."""
    key = ["__seg", "__code"]
    index, probes = tables(prints, radius, segments)
    many = materialise(index.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > crowded))
    total = prints.count() * segments
    flag = lambda df: join_by_key(df, many, ["__code", "__seg"], "__n", total, F.col("__fp"))
    if many.take(1):
        probes = materialise(flag(probes))
        index = flag(index).filter("__n IS NULL").drop("__n")
        whole = met_whole(probes.filter("__n IS NOT NULL").select("__fp").distinct(), radius)
        probes = probes.filter("__n IS NULL").drop("__n")
    met = probes.withColumnRenamed("__fp", "__a").join(index.withColumnRenamed("__fp", "__b"), key)
    found = met.filter((F.col("__a") != F.col("__b")) & within(F.col("__a"), F.col("__b"), radius)).select("__a", "__b")
    return (found.unionByName(whole) if many.take(1) else found).distinct()


def components(edges: DataFrame, start: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """(__fp, __root): each node of the edges (__a, __b) and the smallest node of its component. start: what this gave of some of the edges."""
    both = materialise(edges.union(edges.select("__b", "__a")))
    labels = both.groupBy("__a").agg(F.min("__b").alias("__m")).select(F.col("__a").alias("__fp"), F.least("__a", "__m").alias("__root"))
    if start is not None:
        labels = labels.join(start.withColumnRenamed("__root", "__s"), "__fp", "left").select("__fp", F.least("__root", "__s").alias("__root"))
    labels = materialise(labels)
    nodes = labels.count()
    for _ in range(rounds):
        told = both.join(labels, both["__b"] == labels["__fp"]).select(F.col("__a").alias("__fp"), "__root")
        least = told.unionByName(labels).groupBy("__fp").agg(F.min("__root").alias("__root"))
        old = labels.select(F.col("__fp").alias("__old_fp"), F.col("__root").alias("__old"))
        least = materialise(least.join(old, F.col("__fp") == F.col("__old_fp")).select("__fp", "__root", (F.col("__root") != F.col("__old")).alias("__new")))
        # Jump to the root's own root; a root may be that of most nodes.
        share = least.groupBy("__root").agg(F.count(F.lit(1)).alias("__n"), F.max("__new").alias("__new"))
        roots = materialise(share.join(least.select(F.col("__fp").alias("__root"), F.col("__root").alias("__rr")), "__root"))
        most, new = roots.agg(F.max("__n"), F.max("__new")).first()
        if not new:
            return labels
        labels = materialise(join_by_key(least.select("__fp", "__root"), roots.drop("__new"), ["__root"], "__n", nodes, F.col("__fp"), most).select("__fp", F.least("__root", "__rr").alias("__root")))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def grouped(rows: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """rows: __id, __th, __fp. One row per fingerprint: __n rows, __first (its least (id, text hash)), __best (that of its component)."""
    prints = materialise(rows.groupBy("__fp").agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("__id", "__th")).alias("__first")))
    roots = components(materialise(links(prints.select("__fp"), radius, segments)))
    rooted = prints.join(roots, "__fp", "left").withColumn("__root", F.coalesce("__root", "__fp"))
    best = rooted.groupBy("__root").agg(F.min("__first").alias("__best"), F.count(F.lit(1)).alias("__k"))
    best, rooted = materialise(best), materialise(rooted)
    total, most = weights(best, "__k")
    return materialise(join_by_key(rooted, best, ["__root"], "__k", total, F.col("__fp"), most).drop("__root", "__k"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), id_of(id_col).alias("__id"), text_of(text_col).alias("__t"))
    rows = materialise(with_fingerprint(rows, "__t", "__fp", words).select("doc_id", "__id", F.lit(0).cast("bigint").alias("__th"), "__fp"))
    groups = grouped(rows, radius, segments)
    out = join_by_key(rows, groups, ["__fp"], "__n", rows.count(), F.col("__id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.nullif(F.col("__best.__id"), F.lit(NULL_ID)).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """The document with the smallest id of each component, with all columns of `docs`."""
    rows = docs.select(whole_row(docs).alias("__row"), id_of(id_col).alias("__id"), F.xxhash64(text_of(text_col)).alias("__th"), text_of(text_col).alias("__t"))
    prints = materialise(with_fingerprint(rows, "__t", "__fp", words).select("__id", "__th", "__fp"))
    keep = grouped(prints, radius, segments).select(F.col("__best.__id").alias("__id"), F.col("__best.__th").alias("__th")).distinct()
    return rows.join(materialise(keep), ["__id", "__th"], "left_semi").dropDuplicates(["__id", "__th"]).select("__row.*")
