"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources get seats (blocks of equally many words) by highest quotients target / (2 k + 1); a source's seats are apportioned
in the same way to its shards, bounded groups of its documents in seeded order. A shard's documents, laid end to end, are
its blocks; with q seats on n blocks each block is taken q div n times and a seeded run of q mod n blocks once more.

Targets: sources weigh 5, 2, 1, repeating, by code point with null last, share 150 % of all words, and stop at twice their
own words; what is above that is shared again by weight until none is above.

Defined results: a null text has no words; a null source is a source, the last; equal words make equal results whatever
the partitioning; rows repeated in doc_id and text each take their own part; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.llm.common import WORD, id_of, join_by_key, materialise, text_of, whole_row

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 8
SHARD_DOCS = 2_000


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """sources: one row each with __source, __words. Adds __weight and __target.

    The shares are min(most * words, weight * level) for the one level at which they sum to the whole: sources stop
    in ascending order of most * words / weight, so running sums in that order find it.
    The windows run over one row per source.
    """
    order = W.orderBy(F.col("__source").asc_nulls_last())
    cap, weight = F.col("__words") * most, F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1)
    out = sources.withColumn("__weight", weight.cast("double")).withColumn("__cap", cap.cast("double"))
    by_ratio = W.orderBy(F.col("__cap") / F.col("__weight"), F.col("__source").asc_nulls_last())
    everything = W.partitionBy()
    out = out.withColumn("__stopped", F.sum("__cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)))
    out = out.withColumn("__open", F.sum("__weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
    # The level if just the sources before this one have stopped; a wrong guess that fits gives a lower one.
    level = (F.sum("__words").over(everything) * share - F.coalesce("__stopped", F.lit(0.0))) / F.col("__open")
    fits = level * F.col("__weight") <= F.col("__cap")
    out = out.withColumn("__level", F.max(F.when(fits, level)).over(everything)).withColumn("__target", F.least("__cap", F.coalesce(F.col("__level") * F.col("__weight"), F.col("__cap"))))
    return out.select("__source", "__words", "__docs", "__weight", "__target")


def sainte_lague(rows: DataFrame, group: list[str], key: list[str], weight: str, seats: Column, out: str) -> DataFrame:
    """Adds `out`: each row's seats, of the group's `seats` by highest quotients weight / (2 k + 1), ties by key.

    round(weight / step) for step = total weight / seats misses the seats by d, at most half the number of rows n. The
    missing seats go to, or come from, the next quotients. A row gains or loses at most (|d| + n) * its share + 1 of them, so
    that many quotients a row suffice: some 3 n rows in all, not one a seat.
    """
    all_, by = W.partitionBy(*group), [F.col(k).asc_nulls_last() for k in key]
    rows = rows.withColumn("__seats", F.greatest(seats, F.lit(0)).cast("bigint")).withColumn("__total", F.sum(weight).over(all_)).withColumn("__count", F.count(F.lit(1)).over(all_))
    rows = rows.withColumn("__share", F.when(F.col("__total") > 0, F.col(weight) / F.col("__total")).otherwise(0.0))
    rows = rows.withColumn("__base", F.floor(F.col("__share") * F.col("__seats") + 0.5)).withColumn("__miss", F.col("__seats") - F.sum("__base").over(all_))
    reach = F.floor((F.abs("__miss") + F.col("__count")) * F.col("__share")).cast("bigint") + 1
    up, down = F.col("__miss") > 0, F.col("__miss") < 0
    steps = F.when(up, reach).when(down, F.least(reach, F.col("__base"))).otherwise(F.lit(0))
    steps = F.when(F.col(weight) > 0, steps).otherwise(F.lit(0))
    tried = rows.withColumn("__step", F.explode_outer(F.when(steps > 0, F.sequence(F.lit(0).cast("bigint"), steps.cast("bigint") - 1))))
    seat = F.when(up, F.col("__base") + F.col("__step")).otherwise(F.col("__base") - 1 - F.col("__step"))
    quotient = F.col(weight) / (2 * seat + 1)
    first = W.partitionBy(*group).orderBy(F.col("__step").isNull(), F.when(up, -quotient).otherwise(quotient), *by, "__step")
    moved = F.when(F.col("__step").isNotNull() & (F.row_number().over(first) <= F.abs("__miss")), F.signum("__miss").cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    tried = tried.withColumn("__moved", moved)
    kept = [c for c in rows.columns if c not in ("__seats", "__total", "__count", "__share", "__base", "__miss")]
    return tried.groupBy(*kept).agg((F.first("__base") + F.sum("__moved")).cast("bigint").alias(out))


def _word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def _named(source_col: str) -> Column:
    """A hash of the source that tells null from every name."""
    return F.xxhash64(F.col(source_col).isNull(), F.col(source_col).cast("string"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Per document: doc_id, __id, __th, __src, size, source_size, target, taken and how: __every (whole copies), __from, __to and __from2, __to2 (word ranges taken once more)."""
    size = materialise(
        docs.select(F.col(id_col).alias("doc_id"), id_of(id_col).alias("__id"), F.xxhash64(text_of(text_col)).alias("__th"), F.col(source_col).cast("string").alias("__source"), _named(source_col).alias("__src"), _word_count(text_of(text_col)).alias("size"))
    )
    per = size.groupBy("__source").agg(F.sum("size").alias("__words"), F.count(F.lit(1)).alias("__docs"))
    named = targets(materialise(per))
    seats = F.round(F.sum("__words").over(W.partitionBy()) * SHARE / block_words)
    named = sainte_lague(named.withColumn("__all", F.lit(1)), ["__all"], ["__source"], "__target", seats, "__source_seats")
    named = materialise(named.withColumn("__key", F.coalesce(F.concat(F.lit("s"), "__source"), F.lit("n"))).drop("__source", "__all", "__weight"))
    rows = join_by_key(size.withColumn("__key", F.coalesce(F.concat(F.lit("s"), "__source"), F.lit("n"))), named, ["__key"], "__docs", size.count(), F.struct("__id", "__th"))
    draw = F.xxhash64(F.lit(seed), "__id", "__th")
    rows = rows.withColumn("__draw", draw).withColumn("__shard", F.pmod(F.xxhash64(F.lit(seed), "__draw"), F.ceil(F.col("__docs") / shard_docs)))
    rows = materialise(rows)
    shards = rows.groupBy("__key", "__shard").agg(F.sum("size").alias("__shard_words"), F.first("__source_seats").alias("__source_seats"))
    shards = sainte_lague(shards, ["__key"], ["__shard"], "__shard_words", F.col("__source_seats"), "__quota")
    shards = shards.withColumn("__blocks", F.ceil(F.col("__shard_words") / block_words)).drop("__source_seats")
    rows = rows.join(shards, ["__key", "__shard"])
    laid = W.partitionBy("__key", "__shard").orderBy("__draw", "__id", "__th").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__at", F.coalesce(F.sum("size").over(laid), F.lit(0)))
    blocks = F.greatest("__blocks", F.lit(1))
    quota = F.least(F.col("__quota"), F.lit(MOST_REPEATS) * F.col("__blocks"))
    start = F.pmod(F.xxhash64(F.lit(seed), "__key", "__shard"), blocks)
    rows = rows.withColumn("__every", F.floor(quota / blocks)).withColumn("__lo", start * block_words).withColumn("__hi", (start + F.pmod(quota, blocks)) * block_words)
    # The run goes round: what reaches beyond the last block goes on from the first.
    within = lambda a, b: (F.least(F.greatest(F.col(a) - F.col("__at"), F.lit(0)), F.col("size")), F.least(F.greatest(b - F.col("__at"), F.lit(0)), F.col("size")))
    lo, hi = within("__lo", F.least(F.col("__hi"), blocks * block_words))
    rows = rows.withColumn("__from", lo).withColumn("__to", F.greatest(lo, hi)).withColumn("__zero", F.lit(0).cast("bigint"))
    lo, hi = within("__zero", F.col("__hi") - blocks * block_words)
    rows = rows.withColumn("__from2", lo).withColumn("__to2", F.greatest(lo, hi))
    taken = F.col("__every") * F.col("size") + F.col("__to") - F.col("__from") + F.col("__to2") - F.col("__from2")
    return rows.select("doc_id", "__id", "__th", "__src", "size", F.col("__words").alias("source_size"), F.col("__target").alias("target"), taken.cast("bigint").alias("taken"), "__every", "__from", "__to", "__from2", "__to2")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_chars_col: str = "n_chars", **options: int) -> DataFrame:
    """The mixed corpus with all columns of `docs`: a row per whole copy taken and one per word range taken; n_chars follows the text."""
    how = plan(docs, id_col, text_col, source_col, **options)
    # Rows repeated in id, text and source have a plan each, and any of them may stand for the others.
    how = how.filter("taken > 0").select("__id", "__th", "__src", F.explode(F.concat(F.array_repeat(F.struct(F.lit(0).cast("bigint").alias("a"), F.col("size").alias("b"), F.lit(True).alias("whole")), F.col("__every").cast("int")), F.filter(F.array(*[F.struct(F.col(f"__from{i}").alias("a"), F.col(f"__to{i}").alias("b"), ((F.col(f"__from{i}") == 0) & (F.col(f"__to{i}") == F.col("size"))).alias("whole")) for i in ("", "2")]), lambda r: r["b"] > r["a"]))).alias("__part"))
    rows = docs.select(whole_row(docs).alias("__row"), id_of(id_col).alias("__id"), F.xxhash64(text_of(text_col)).alias("__th"), text_of(text_col).alias("__t"), _named(source_col).alias("__src")).dropDuplicates(["__id", "__th", "__src"])
    both = rows.join(how, ["__id", "__th", "__src"])
    # Words with the blanks that follow them, so that a range keeps its line breaks.
    spaced = F.split(F.regexp_replace("__t", r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    part = F.array_join(F.slice(spaced, (F.col("__part.a") + 1).cast("int"), (F.col("__part.b") - F.col("__part.a")).cast("int")), "")
    both = both.withColumn("__text", F.when(F.col("__part.whole"), F.col("__t")).otherwise(part))
    changed = {text_col: F.col("__text"), n_chars_col: F.length("__text").cast("bigint")}
    return both.select(*[changed[c].alias(c) if c in changed else F.col("__row")[c].alias(c) for c in docs.columns])
