"""Exact deduplication by two-pass Bloom filtering.

Pass one counts the bits that the hashes of all texts would set and keeps those that two rows set: a filter of
possibly repeated hashes. Pass two tests each row where it lies; only rows that may be repeated are shuffled and grouped by SHA-256,
and the rest pass straight through.

Texts are read once; both passes go over a table of their hashes. It is sorted by hash within each of its files, and its range of hashes is cut
so that the filter of each cut can be broadcast: a cut reads only its own pages. So the share of rows that
pass by chance, 1 / bits, is the same at every size.

Defined results: a null text equals an empty one; texts are equal when identical; of equal texts the row with the
largest doc_id stays (a null doc_id is the smallest); of repeated rows, equal in doc_id and text, exactly one stays.
An empty table gives an empty result. Other columns, whatever their names, don't matter; `drop_duplicates` hands them on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm.common import BitFilter, id_of, join_by_key, materialise, text_of, whole_row

#: Bits of the filter a row: one row in so many passes by chance.
BITS = 32


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), id_of(id_col).alias("__id"), text_of(text_col).alias("__t"))
    return materialise(rows.select("doc_id", "__id", F.xxhash64("__t").alias("__h"), F.sha2("__t", 256).alias("text_sha256")).sortWithinPartitions("__h"))


def marked(rows: DataFrame, bits: int = BITS, most_bits: int = BitFilter.MOST_BITS) -> DataFrame:
    """rows, a table sorted by __h within its files, with __maybe: whether another row may have the same hash."""
    total = rows.count()
    cuts = max(1, -(-total * bits // most_bits))
    size, out = min(most_bits, BitFilter.size_for(-(-total // cuts), bits)), []
    for i in range(cuts):
        least, most = -(2**63) + 2**64 * i // cuts, -(2**63) + 2**64 * (i + 1) // cuts - 1
        own = rows.filter(F.col("__h").between(least, most))
        bit = own.select(BitFilter.positions(F.col("__h"), size, 1)[0].cast("int").alias("__pos"))
        twice = bit.groupBy("__pos").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(F.col("__pos").cast("bigint").alias("__pos"))
        out.append(BitFilter.at(twice, size).mark(own, F.col("__h"), "__maybe"))
    return reduce(DataFrame.unionByName, out)


def _groups(maybe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each text and doc_id with the times it is repeated (__n); and one for each text: __keep, group_size, __ids (its rows in the former)."""
    ids = materialise(maybe.groupBy("text_sha256", "__id").agg(F.first("doc_id").alias("doc_id"), F.first("__h").alias("__h"), F.count(F.lit(1)).alias("__n")))
    return ids, materialise(ids.groupBy("text_sha256").agg(F.max(F.struct("__id", "doc_id")).alias("__keep"), F.first("__h").alias("__h"), F.sum("__n").alias("group_size"), F.count(F.lit(1)).alias("__ids")))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. options: those of `marked`."""
    rows = marked(_hashed(docs, id_col, text_col), **options)
    once = rows.filter("not __maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    ids, groups = _groups(rows.filter("__maybe"))
    joined = join_by_key(ids, groups.drop("__h"), ["text_sha256"], "__ids", ids.count(), F.col("__id"))
    again = joined.select(
        "doc_id", F.col("__keep.doc_id").alias("keep_id"), "group_size", "text_sha256", (F.col("__id") == F.col("__keep.__id")).alias("__best"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))).alias("__copy"),
    ).select("doc_id", "keep_id", "group_size", (F.col("__best") & (F.col("__copy") == 1)).alias("kept"), "text_sha256")
    return once.unionByName(again)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows that stay, with all columns of `docs`.

    A filter of the texts found repeated decides which rows move; beyond 67 million of those texts it lets more through.
    """
    _, groups = _groups(marked(_hashed(docs, id_col, text_col), **options).filter("__maybe"))
    groups = materialise(groups.filter("group_size > 1").select("text_sha256", "__h", F.col("__keep.__id").alias("__best"), "group_size"))
    rows = docs.select(whole_row(docs).alias("__row"), id_of(id_col).alias("__id"), F.xxhash64(text_of(text_col)).alias("__h"), F.sha2(text_of(text_col), 256).alias("text_sha256"))
    rows = BitFilter.of(groups, F.col("__h"), groups.count()).mark(rows, F.col("__h"), "__maybe")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    met = join_by_key(rows.filter("__maybe"), groups.drop("__h"), ["text_sha256"], "group_size", total, F.struct("__id"))
    best = met.filter(F.col("__best") == F.col("__id")).dropDuplicates(["text_sha256", "__id"])
    return rows.filter("not __maybe").select("__row.*").unionByName(met.filter("__best IS NULL").select("__row.*")).unionByName(best.select("__row.*"))
