"""Interaction of five filters, audited for every order in which they can be applied, by a stream that retracts.

Filters: A few words, B few distinct words, C many capitals, D odd characters, E a text that a smaller id has too. A to D depend on
the text alone and are told by Spark's functions; E depends on what other files hold. All files are processed as
available-now micro-batches. State is keyed by the text's SHA-256 and holds its least id so far with the parts of the rows that have
that id. A row that comes is counted in its part under its mask of failures; when a smaller id arrives, the earlier least rows'
masks are retracted from their parts' counters and come back with E set. The audit is read off the counters: 32 masks a part, whatever
the table's size.

The state is a table in the shared folder to which a batch appends the texts whose least rows it changed; a batch joins its own
texts, one row each, with what the batches before it left. Its rows, state and changes of the counters are written under its number, so a
batch that is run again replaces them. A text that a third of all rows have is one row in that join; its rows meet the outcome by broadcast.
A keyed operator in Python was tried first: at 2 to 4 ms a text it was beyond the limit.

Defined results: a null text or part is an empty one, a null id is the smallest; rows of the same id don't make each other fail E;
repeated rows count one by one; a document has a label if any of its label rows says so, and none if its id is null; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.llm.common import WORD, id_of, join_by_key, shared_folder, text_of

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of files that a micro-batch takes for each core.
BATCH_BYTES = 64 << 20
_ROWS = "key string, id bigint, part string, mask int"
_TEXTS = "key string, id bigint, mask int, parts array<struct<part:string,n:bigint>>, number bigint"
_COUNTERS = "part string, mask int, good boolean, toxic boolean, n bigint"


def failures(text: Column) -> Column:
    """Bits of A to D: under 200 words; 100 x distinct words < 50 x words; 100 x [A-Z] > 2 x code points; any of #$%&*|."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    size = lambda x: F.size(x).cast("bigint")
    tests = [
        F.size(words) < 200,
        size(F.array_distinct(words)) * 100 < size(words) * 50,
        F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") * 100 > F.length(text).cast("bigint") * 2,
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def _changes(rows: DataFrame, texts: DataFrame, save: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What a batch's rows change: (id, part, mask, n) of the counters, and the texts whose least rows are others now. texts: the state, all its versions."""
    known = texts.groupBy("key").agg(F.min_by(F.struct("id", "parts"), F.struct("id", -F.col("number"))).alias("old"))
    own = rows.groupBy("key").agg(F.min("id").alias("low"), F.first("mask").alias("mask"), F.count(F.lit(1)).alias("n"))
    met = save(own.join(known, "key", "left").select("key", "mask", "n", "low", "old", F.least("low", "old.id").alias("least")))
    total = met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = save(join_by_key(rows, met.select("key", "least", "n"), ["key"], "n", total, F.col("id")))
    come = placed.select("id", "part", F.when(F.col("id") > F.col("least"), F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask")).alias("mask"), F.lit(1).cast("bigint").alias("n"))
    beaten = met.filter(F.col("low") < F.col("old.id")).select(F.col("old.id").alias("id"), "mask", F.explode("old.parts").alias("p"))
    ways = F.explode(F.array(F.struct(F.col("mask"), (-F.col("p.n")).alias("n")), F.struct(F.col("mask").bitwiseOR(COPY).alias("mask"), F.col("p.n").alias("n")))).alias("w")
    beaten = beaten.select("id", F.col("p.part").alias("part"), ways).select("id", "part", "w.mask", "w.n")
    parts = placed.filter("id = least").groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.collect_list(F.struct("part", "n")).alias("parts"))
    kept = F.when(F.col("old.id") == F.col("least"), F.col("old.parts")).otherwise(F.array().cast("array<struct<part:string,n:bigint>>"))
    new = met.join(parts, "key").select("key", F.col("least").alias("id"), "mask", F.concat(kept, F.col("parts")).alias("parts"))
    return come.unionByName(beaten), new


def count_masks(folder: str, labels: DataFrame, like: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", batch_bytes: int | None = None, files: int | None = None) -> DataFrame:
    """part, mask, good, toxic and n over all Parquet files of `folder`, which have the schema of `like`; `files` takes so many files a batch instead of bytes."""
    spark = labels.sparkSession
    base = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    says = lambda label: F.max(F.coalesce(F.col(label) == 1, F.lit(False))).alias(label)
    labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(says("quality"), says("toxic")).write.parquet(f"{base}/labels")
    spark.createDataFrame([], _COUNTERS).write.parquet(f"{base}/counters/batch=none")

    spark.createDataFrame([], _TEXTS).write.parquet(f"{base}/texts/batch=none")

    def counted(batch: DataFrame, number: int) -> None:
        at = lambda name: f"{base}/{name}/batch={number}"
        saved = iter(("met", "placed"))

        def save(df: DataFrame) -> DataFrame:
            path = at(next(saved))
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        batch.write.mode("overwrite").parquet(at("rows"))
        texts = spark.read.schema(_TEXTS).parquet(*[f"{base}/texts/batch={i}" for i in ("none", *range(number))])
        changes, new = _changes(spark.read.schema(_ROWS).parquet(at("rows")), texts, save)
        new.withColumn("number", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(at("texts"))
        own = changes.groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).filter("n <> 0")
        own = own.join(spark.read.schema("id bigint, quality boolean, toxic boolean").parquet(f"{base}/labels"), "id", "left")
        own = own.groupBy("part", "mask", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))
        own.filter("n <> 0").write.mode("overwrite").parquet(at("counters"))

    stream = spark.readStream.schema(like.schema)
    stream = stream.option("maxFilesPerTrigger", files) if files else stream.option("maxBytesPerTrigger", batch_bytes or BATCH_BYTES * spark.sparkContext.defaultParallelism)
    # A file is read as a stream by a pattern only; this one matches the name alone.
    rows = stream.parquet(re.sub(r"(\w)/*$", r"[\1]", folder)).select(id_of(id_col).cast("bigint").alias("id"), text_of(text_col).alias("__t"), text_of(part_col).alias("part"))
    rows = rows.select(F.sha2("__t", 256).alias("key"), "id", "part", failures(F.col("__t")).alias("mask"))
    rows.writeStream.foreachBatch(counted).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    counters = spark.read.schema(_COUNTERS).option("recursiveFileLookup", "true").parquet(f"{base}/counters")
    return counters.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def report(counters: DataFrame) -> DataFrame:
    """A row for each part, order and step. Counters become arrays by mask, one row a part; orders are a fixed list."""
    masks = 1 << len(FILTERS)

    def by_mask(rows: Column) -> Column:
        return F.array(*[F.sum(F.when((F.col("mask") == m) & rows, F.col("n")).otherwise(0)) for m in range(masks)])

    parts = counters.groupBy("part").agg(by_mask(F.lit(True)).alias("all"), by_mask(F.col("good")).alias("good"), by_mask(F.col("toxic")).alias("toxic"))
    steps = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order")
    own = parts.select("*", steps).select("*", F.explode(F.array(*[F.lit(i).cast("int") for i in range(1, len(FILTERS) + 1)])).alias("step"))
    bit = lambda at: F.call_function("shiftleft", F.lit(1), F.ascii(F.substring("filter_order", at, F.lit(1))) - ord("A"))
    own = own.withColumn("own", bit(F.col("step"))).withColumn("earlier", F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda a, i: a.bitwiseOR(F.when(i < F.col("step"), bit(i)).otherwise(0))))

    def total(counts: str, holds) -> Column:  # noqa: ANN001
        return F.aggregate(F.sequence(F.lit(0), F.lit(masks - 1)), F.lit(0).cast("bigint"), lambda a, m: a + F.when(holds(m), F.get(F.col(counts), m)).otherwise(0))

    removed = lambda m: (m.bitwiseAND(F.col("own")) != 0) & (m.bitwiseAND(F.col("earlier")) == 0)
    # A mask of k failures is removed by each of its filters in 120 / k of the orders.
    orders = len(list(permutations(FILTERS)))
    shapley = F.aggregate(F.sequence(F.lit(1), F.lit(masks - 1)), F.lit(0).cast("bigint"), lambda a, m: a + F.when(m.bitwiseAND(F.col("own")) != 0, F.get(F.col("all"), m) * F.floor(F.lit(orders) / F.bit_count(m))).otherwise(0))
    return own.select(
        "part", "filter_order", "step",
        total("all", lambda m: m.bitwiseAND(F.col("own").bitwiseOR(F.col("earlier"))) == 0).alias("kept"), total("all", removed).alias("removed"),
        total("all", lambda m: (m.bitwiseAND(F.col("own")) != 0) & (m.bitwiseAND(F.col("earlier")) != 0)).alias("redundant"), total("all", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(folder: str, labels: DataFrame, like: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return report(count_masks(folder, labels, like, **options))
