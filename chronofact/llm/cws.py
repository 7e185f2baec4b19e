"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, weighted by how often they stand in it. For each of SAMPLES samples every term draws, from its
hash and the sample's number alone, r and c from Gamma(2, 1) and b evenly from (0, 1); with weight w, t = floor(ln w / r + b),
ln y = r (t - b) and ln a = ln c - ln y - r. The sample is the (term, t) with the least a. Two texts share a sample with
probability their generalised Jaccard similarity, sum of minima over sum of maxima of weights.

Each evaluation is one long: ln a in fixed point above 31 bits of the hash of (term, t), so that a sample is a plain minimum
that combines before any shuffle. LANE bits of a sample's hash are kept, four samples a long: unequal samples look equal once in 65,536. A
likeness is an estimate whose standard error is sqrt(J (1 - J) / SAMPLES): with 128 samples 0.035 at a true 0.8, 0.044 at most.

Defined results: a null text is empty; a text without words has the fingerprint of one void term, like only to another such;
equal texts have equal fingerprints; the next document is the one with the next smaller doc_id, of equal ids the one with the smaller
text hash, after the last the first; rows repeated in id and text are one document there; a single document is its own
next; a null doc_id is the smallest id; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.llm.common import id_of, materialise, text_of

SAMPLES = 128
LANE = 16
#: Terms that could only win with probability e^-NEVER aren't drawn at first; texts that lack a sample then are drawn in full.
NEVER = 20.0
#: Characters of text that a task takes at once, and the most tasks.
TASK_CHARS, MOST_TASKS = 8_000_000, 20_000
KEYS = ["__id", "__th"]
_MASK, _LANE_MASK = 2147483647, 65535


def _least(terms: DataFrame, keys: list[str], samples: int, all_terms: bool, versions: int) -> DataFrame:
    """terms: keys, __h, and of each version __lw<v> and __most<v>. (keys, __k, __s<v>): the least value of each sample; unless all terms are drawn, where a is at most never by the number of words.

    A term and sample is drawn once for all versions of a text: r, c and b depend on neither the text nor the weight.
    """
    # A sample's number stands in the bits above 47; another bit makes the second draw.
    numbers = F.array(*[F.lit(k << 48).cast("bigint") for k in range(samples)])
    own = [f"__{x}{v}" for v in range(versions) for x in ("lw", "most")]
    each = terms.select(*keys, "__h", *own, F.explode(numbers).alias("__x"))
    mixed = F.col("__h").bitwiseXOR(F.col("__x"))
    g, h = F.xxhash64(mixed), F.xxhash64(mixed.bitwiseXOR(F.lit(1 << 47).cast("bigint")))
    unit = lambda word, shift, bits: (F.call_function("shiftrightunsigned", word, F.lit(shift)).bitwiseAND(F.lit(2**bits - 1).cast("bigint")) + F.lit(0.5)) * F.lit(2.0**-bits)
    p, q = unit(g, 0, 32) * unit(g, 32, 32), unit(h, 0, 22) * unit(h, 22, 22)
    most = [F.coalesce(f"__most{v}", F.lit(0.0)) for v in range(versions)]  # so that no test for null goes down to the scan and splits the texts there
    if not all_terms:
        each = each.filter((4 / (1 + q) - 2) * p <= (most[0] if versions == 1 else F.greatest(*most)))
    r, c, b = -F.log(p), -F.log(q), unit(h, 44, 20)
    values = []
    for v in range(versions):
        lw = F.coalesce(f"__lw{v}", F.lit(0.0))
        t = F.floor(lw / r + b)
        ln_a = F.log(c) - r * (t - b + 1)
        high = ((ln_a + 400.0) * F.lit(float(1 << 21))).cast("bigint")
        value = F.call_function("shiftleft", high, F.lit(32)) + F.xxhash64("__h", t).bitwiseAND(F.lit(_MASK))
        there = most[v] > 0
        values.append(F.when(there if all_terms else there & (ln_a <= F.log(most[v]) - lw), value).alias(f"__s{v}"))
    drawn = each.select(*keys, F.call_function("shiftrightunsigned", F.col("__x"), F.lit(48)).alias("__k"), *values)
    return drawn.groupBy(*keys, "__k").agg(*[F.min(f"__s{v}").alias(f"__s{v}") for v in range(versions)])


def signatures(words: DataFrame, keys: list[str], samples: int = SAMPLES, never: float | None = NEVER, versions: int = 1) -> DataFrame:
    """words: keys, __v (the text's version, from 0, if there are several), __n (its number of words) and __h (a word's hash), a row for each word of each text. Per keys: of each version __sig<v>, of a single one __sig,
    an array of longs of four samples each; and __c, the samples found of the version that has fewest.

    A text's least a is exponential with rate __n, so it exceeds never / __n with probability e^-never. As a >= c e^-r / w and
    c = -ln q >= 4 / (1 + q) - 2, most terms are seen to lie above that without a logarithm and are passed over; a sample counts only if it lies below. Without `never` all terms are drawn.
    If `words` is partitioned by some of the keys, no aggregation shuffles.
    """
    weights, own = [], []
    for v in range(versions):
        mine = F.col("__v") == v if versions > 1 else F.lit(True)
        weights += [F.count_if(mine).cast("double").alias(f"__w{v}"), F.max(F.when(mine, F.col("__n"))).alias(f"__n{v}")]
        w = F.nullif(F.col(f"__w{v}"), F.lit(0.0))
        own += [F.log(w).alias(f"__lw{v}"), (w * (never or 1.0) / F.greatest(f"__n{v}", F.lit(1))).alias(f"__most{v}")]
    terms = words.groupBy(*keys, "__h").agg(*weights).select(*keys, "__h", *own)
    lane = lambda v: F.call_function("shiftleft", F.col(f"__s{v}").bitwiseAND(F.lit(_LANE_MASK).cast("bigint")), (F.col("__k") % 4 * LANE).cast("int"))
    least = _least(terms, keys, samples, never is None, versions)
    lanes = least.groupBy(*keys, F.floor(F.col("__k") / 4).alias("__q")).agg(*[x for v in range(versions) for x in (F.bit_or(lane(v)).alias(f"__l{v}"), F.count(f"__s{v}").alias(f"__c{v}"))])
    each = [f"__l{v}" for v in range(versions)]
    both = lanes.groupBy(*keys).agg(*[F.sum(f"__c{v}").alias(f"__c{v}") for v in range(versions)], F.array_sort(F.collect_list(F.struct("__q", *each))).alias("__ls"))
    found = F.col("__c0") if versions == 1 else F.least(*[f"__c{v}" for v in range(versions)])
    return both.select(*keys, found.alias("__c"), *[F.transform("__ls", _lane(v)).alias(f"__sig{v}" if versions > 1 else "__sig") for v in range(versions)])


def _lane(v: int) -> Callable[[Column], Column]:
    return lambda x: x[f"__l{v}"]


def completed(draw: Callable[[DataFrame, float | None], DataFrame], words: DataFrame, keys: list[str], samples: int, never: float) -> DataFrame:
    """The table that `draw` makes of the words, with keys and __c; texts that lack a sample are drawn once more with all their terms, so that signatures are exact."""
    sig = materialise(draw(words, never))
    short = sig.filter(F.col("__c") < samples).select(*keys)
    if short.take(1):
        sig = sig.filter(F.col("__c") == samples).unionByName(materialise(draw(words.join(short, keys, "left_semi"), None)))
    return sig.drop("__c")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    lanes = lambda x: sum(((F.call_function("shiftrightunsigned", x, F.lit(i * LANE)).bitwiseAND(F.lit(_LANE_MASK).cast("bigint")) == 0).cast("int") for i in range(4)), F.lit(0))
    same = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + lanes(x))
    return same / (F.size(a) * 4)


def hex_of(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _exploded(rows: DataFrame) -> DataFrame:
    """rows with an array __ws: a row for each word, as __h, with their number __n; a text without words has one with a null hash and number 0."""
    rest = [c for c in rows.columns if c != "__ws"]
    return rows.select(*rest, F.size("__ws").alias("__n"), F.explode_outer("__ws").alias("__w")).select(*rest, "__n", F.xxhash64("__w").alias("__h"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, never: float = NEVER) -> DataFrame:
    """Per document: doc_id, fingerprint. No text is shuffled unless rows are repeated."""
    rows = docs.select(F.col(id_col).alias("doc_id"), id_of(id_col).alias("__id"), text_of(text_col).alias("__t")).withColumn("__th", F.xxhash64("__t"))
    texts = rows.select(*KEYS, "__t")
    if rows.groupBy(*KEYS).count().filter("count > 1").take(1):
        texts = texts.dropDuplicates(KEYS)
    words = _exploded(texts.select(*KEYS, _words(F.col("__t")).alias("__ws")))
    sig = completed(lambda w, never: signatures(w, KEYS, samples, never), words, KEYS, samples, never)
    out = rows.select("doc_id", *KEYS).join(sig, KEYS)
    return out.select("doc_id", hex_of(F.col("__sig")).alias("fingerprint"))


def following(ids: DataFrame) -> DataFrame:
    """ids: KEYS (distinct) and __n. Each with its successor's KEYS (__nid, __nth), descending, after the last the first.

    Rows are dealt out by range; within a range the successor is the next row, at its end the first row of the next range.
    """
    desc = [F.col(k).desc() for k in KEYS]
    dealt = materialise(ids.repartitionByRange(*desc).withColumn("__range", F.spark_partition_id()))
    first = dealt.groupBy("__range").agg(F.max(F.struct(*KEYS)).alias("__f"))
    ranges = W.orderBy("__range")  # one row a range
    first = first.select("__range", F.coalesce(F.lead("__f").over(ranges), F.first("__f").over(ranges.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("__after"))
    within = F.lead(F.struct(*KEYS)).over(W.partitionBy("__range").orderBy(*desc))
    out = dealt.withColumn("__next", within).join(F.broadcast(first), "__range")
    out = out.withColumn("__next", F.coalesce("__next", "__after"))
    return materialise(out.select(*KEYS, "__n", F.col("__next.__id").alias("__nid"), F.col("__next.__th").alias("__nth")))


def edited_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, never: float = NEVER) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The text moves once, to meet its place in the order, and the heads of next documents once more; all that is counted
    for a document is then counted where it lies.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), id_of(id_col).alias("__id"), text_of(text_col).alias("__t")).withColumn("__th", F.xxhash64("__t"))
    ids = materialise(rows.select("doc_id", *KEYS, F.length("__t").cast("bigint").alias("__n")))
    places = materialise(ids.groupBy(*KEYS).agg(F.first("__n").alias("__n"), F.count(F.lit(1)).alias("__k")))
    texts = rows.select(*KEYS, "__t")
    if places.filter("__k > 1").take(1):  # rows repeated in id and text are one place
        texts = texts.dropDuplicates(KEYS)
    next_ = following(places.select(*KEYS, "__n"))
    total = places.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, total // TASK_CHARS))
    texts = texts.repartition(tasks, *KEYS)
    wanted = next_.select(F.col("__nid").alias("__id"), F.col("__nth").alias("__th"), F.col("__id").alias("__pid"), F.col("__th").alias("__pth"), F.floor(F.col("__n") / 2).cast("int").alias("__half"))
    heads = texts.join(wanted.repartition(tasks, *KEYS).hint("merge"), KEYS).select(F.col("__pid").alias("__id"), F.col("__pth").alias("__th"), F.left("__t", F.col("__half")).alias("__head"))
    n = F.length("__t")
    edited = F.concat(F.left("__t", n - F.floor(n / 2).cast("int")), F.col("__head"))
    both = texts.join(heads.repartition(tasks, *KEYS).hint("merge"), KEYS).select(*KEYS, "__t", edited.alias("__edited"))
    versions = both.select(*KEYS, F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("__t").alias("t")), F.struct(F.lit(1).alias("v"), F.col("__edited").alias("t")))).alias("__x"))
    words = _exploded(versions.select(*KEYS, F.col("__x.v").alias("__v"), _words(F.col("__x.t")).alias("__ws")))

    def drawn(words: DataFrame, never: float | None) -> DataFrame:
        sig = signatures(words, KEYS, samples, never, versions=2).withColumnsRenamed({"__sig0": "__own", "__sig1": "__edited"})
        # The texts meet once more for the hash, out of the same shuffle files.
        return sig.join(both.select(*KEYS, F.sha2("__edited", 256).alias("__sha")).hint("merge"), KEYS)

    sig = completed(drawn, words, KEYS, samples, never)
    links = next_.select(*KEYS, "__nid", "__nth")
    after = sig.select(F.col("__id").alias("__nid"), F.col("__th").alias("__nth"), F.col("__own").alias("__next"))
    all_ = sig.join(links, KEYS).join(after, ["__nid", "__nth"])
    out = ids.join(all_, KEYS)
    return out.select(
        "doc_id", F.col("__n").alias("n_chars"), F.col("__sha").alias("edited_sha256"), hex_of(F.col("__own")).alias("fingerprint"), hex_of(F.col("__edited")).alias("edited_fingerprint"),
        likeness(F.col("__own"), F.col("__edited")).alias("near_edited"), likeness(F.col("__own"), F.col("__next")).alias("near_next"),
    )
