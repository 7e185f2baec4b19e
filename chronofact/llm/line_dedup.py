"""Line deduplication: explode, hash, count documents per hash, drop, reassemble by position.

A line's key is the line stripped of ASCII white space, A-Z lower-cased. Only 128-bit hashes of keys are shuffled for the
counts; the text moves once, to meet the positions that its document loses.

Defined results: a null or empty text is one empty line; a null doc_id is the smallest id; rows that share a doc_id
are one document for the counts, and each row is reassembled by itself; an empty table gives an empty result; other
columns don't matter to `line_report` and are handed on by `drop_lines`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm.common import BLANKS, id_of, join_by_key, lower_ascii, materialise, text_of, whole_row


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(whole_row(docs).alias("__row"), id_of(id_col).alias("__id"), F.xxhash64(text_of(text_col)).alias("__th"), text_of(text_col).alias("__t"))


def dropped_positions(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(__id, __th) of documents that lose lines, with the positions lost."""
    lines = rows.select("__id", "__th", F.posexplode(F.split("__t", "\n", -1)).alias("__pos", "__line"))
    lines = lines.select("__id", "__th", "__pos", lower_ascii(F.btrim("__line", F.lit(BLANKS))).alias("__key")).filter(F.length("__key") >= min_chars)
    lines = lines.select("__id", "__th", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(1), "__key").alias("__h2"))
    if min_docs == 2:  # two documents or more: the smallest and the largest id differ
        found = lines.groupBy("__h1", "__h2").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"), F.count(F.lit(1)).alias("__n")).filter("__first < __last")
    else:
        each = lines.groupBy("__h1", "__h2", "__id").agg(F.count(F.lit(1)).alias("__k"))
        found = each.groupBy("__h1", "__h2").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__docs"), F.sum("__k").alias("__n")).filter(F.col("__docs") >= min_docs)
    found = materialise(found.select("__h1", "__h2", "__first", "__n"))
    total = found.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    lost = join_by_key(lines, found, ["__h1", "__h2"], "__n", total, F.struct("__id", "__pos")).filter(F.col("__first") < F.col("__id"))
    return lost.groupBy("__id", "__th").agg(F.collect_set("__pos").alias("__lost"))


def _reassembled(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    rows = _rows(docs, id_col, text_col)
    lost = dropped_positions(rows, min_chars, min_docs)
    both = rows.join(lost, ["__id", "__th"], "left").withColumn("__lines", F.split("__t", "\n", -1))
    n = F.size("__lines")
    rest = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__lost"))
    kept = F.array_join(F.transform(rest, lambda i: F.element_at("__lines", i + 1)), "\n")
    lost_any = F.col("__lost").isNotNull()
    return both.select("__row", F.when(lost_any, kept).otherwise(F.col("__t")).alias("__kept"), n.cast("bigint").alias("__n_lines"), F.when(lost_any, F.size("__lost")).otherwise(0).cast("bigint").alias("__n_lost"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_text."""
    out = _reassembled(docs, id_col, text_col, min_chars, min_docs)
    return out.select(F.col("__row")[id_col].alias("doc_id"), F.col("__n_lines").alias("n_lines"), F.col("__n_lost").alias("n_dropped"), F.col("__kept").alias("kept_text"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """`docs` with the dropped lines taken out of the text, all columns handed on."""
    out = _reassembled(docs, id_col, text_col, min_chars, min_docs)
    return out.select(*[F.col("__kept").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns])
