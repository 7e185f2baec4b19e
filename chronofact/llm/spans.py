"""Places of regular-expression matches in whole texts, in SQL functions alone.

A text splits at the matches of a pattern into one piece more than there are matches, so a match starts where the pieces and
matches before it end. Pieces and matches become rows and a running sum gives the places: linear, however many
matches a text has. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.llm.common import join_by_key, materialise

BLANKS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Kind:
    """A pattern, the test its matches must pass (`__m` is the match), and a cheap test that any text with a match passes."""

    name: str
    pattern: str
    passes: Column
    hint: Column


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _last(words: Column, n: int) -> Column:
    return F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n))


def find(rows: DataFrame, keys: list[str], text: str, kinds: list[Kind], around: int = 0) -> DataFrame:
    """keys (rows that share them hold one text), kind, rank (of the kind), start, end, match: the matches that pass, leftmost, non-overlapping per kind.

    With `around`, also before and after: so many whole words on either side. A match of the kind stands apart from what touches it;
    the words reach across one other match, passed or failed.
    """
    gap = lambda x: F.struct(F.length(x).alias("n"), *([_last(words_of(x), around).alias("last"), F.slice(words_of(x), 1, around).alias("first")] if around else []))
    found = []
    for rank, kind in enumerate(kinds):
        pattern = F.lit(kind.pattern)
        some = F.when(kind.hint, F.regexp_extract_all(text, pattern, F.lit(0)))
        found.append(F.struct(F.lit(rank).alias("rank"), some.alias("m"), F.when(F.size(some) > 0, F.transform(F.split(text, kind.pattern, -1), gap)).alias("gaps")))
    each = rows.select(*keys, F.explode(F.array(*found)).alias("__k")).filter(F.size("__k.m") > 0)
    each = each.select(*keys, F.col("__k.rank").alias("rank"), F.posexplode(F.arrays_zip(F.col("__k.m").alias("m"), F.slice("__k.gaps", F.lit(1), F.size("__k.m")).alias("gap"), F.slice("__k.gaps", F.lit(2), F.size("__k.m")).alias("next"))).alias("__i", "__z"))
    each = each.withColumn("__m", F.col("__z.m")).withColumn("__len", F.length("__m").cast("bigint"))
    # Rows repeated in all keys count once.
    each = each.repartition(*keys, "rank").dropDuplicates([*keys, "rank", "__i"])
    order = W.partitionBy(*keys, "rank").orderBy("__i")
    upto = F.sum(F.col("__z.gap.n") + F.col("__len")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    each = each.withColumn("end", upto).withColumn("start", F.col("end") - F.col("__len"))
    if around:
        before = F.concat(F.coalesce(F.concat(F.lag("__z.gap.last").over(order), words_of(F.lag("__m").over(order))), F.array().cast("array<string>")), F.col("__z.gap.last"))
        after = F.concat(F.col("__z.next.first"), F.coalesce(F.concat(words_of(F.lead("__m").over(order)), F.lead("__z.next.first").over(order)), F.array().cast("array<string>")))
        each = each.withColumn("before", _last(before, around)).withColumn("after", F.slice(after, 1, around))
    passes, name = F.lit(False), F.lit("")
    for rank, kind in enumerate(kinds):
        passes, name = F.when(F.col("rank") == rank, kind.passes).otherwise(passes), F.when(F.col("rank") == rank, F.lit(kind.name)).otherwise(name)
    return each.filter(passes).select(*keys, name.alias("kind"), "rank", "start", "end", F.col("__m").alias("match"), *(["before", "after"] if around else []))


def replaced(rows: DataFrame, keys: list[str], text: str, spans: DataFrame, out: str) -> DataFrame:
    """rows with `out`: the text with its spans replaced. spans: keys, start, end, by. Spans that overlap are replaced as one, by what stands for the
    first and longest of them.

    Pieces are cut from the text's four bytes a code point, so that a cut costs its own length; a byte order mark keeps each piece whole.
    """
    order = W.partitionBy(*keys).orderBy("start", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.select(*keys, "start", "end", "by").distinct().withColumn("__new", (F.coalesce(F.col("start") >= reach, F.lit(True))).cast("int"))
    spans = spans.withColumn("__c", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    whole = spans.groupBy(*keys, "__c").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("by", F.struct("start", -F.col("end"), "by")).alias("by"))
    lists = whole.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "by"))).alias("__spans"))
    counts = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).join(lists, keys))
    total = counts.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]
    met = join_by_key(rows, counts, keys, "__rows", total, F.monotonically_increasing_id())
    raw, mark = F.encode(F.col(text), "UTF-32"), F.unhex(F.lit("0000FEFF"))
    cut = lambda a, n: F.decode(F.concat(mark, F.substring(F.col("__raw"), (4 * a + 1).cast("int"), (4 * n).cast("int"))), "UTF-32")
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("__spans", lambda s: s["end"]))
    pieces = F.transform("__spans", lambda s, i: F.concat(cut(F.element_at(ends, i + 1), s["start"] - F.element_at(ends, i + 1)), s["by"]))
    last = F.element_at("__spans", -1)["end"]
    changed = F.concat(F.array_join(pieces, ""), cut(last, F.length(text) - last))
    met = met.withColumn("__raw", F.when(F.col("__spans").isNotNull(), raw))
    return met.withColumn(out, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(changed)).drop("__spans", "__raw")


def listed(spans: Column) -> Column:
    """kind:start:end of structs with start, rank, end, kind, comma-joined in that order."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(spans: DataFrame, keys: list[str], base: int) -> DataFrame:
    """Per key: all (every span) and base (those with a rank below `base`), as arrays of structs that sort by place."""
    one = F.struct("start", "rank", "end", "kind")
    return spans.groupBy(*keys).agg(F.collect_list(one).alias("all"), F.collect_list(F.when(F.col("rank") < base, one)).alias("base"))
