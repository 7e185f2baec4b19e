"""How the sources of a language differ in their words, by in-mapper stripes.

A task folds whole documents into stripes: for each language and term the number of its documents so far and the occurrences by
source. Beyond HELD entries it spills what it has as rows and goes on. Stripes of a key are merged in sorted order, a batch at a time,
by the task that the key is dealt to; a hot term sends one stripe a spill, never a row an occurrence. Terms of fewer than
MIN_DOCS documents go. The merged stripes, dealt by language and blocks of terms, directly emit each pair's sum of divergences over
the block and each group's foremost terms; sums add up, foremost terms compete.

All arithmetic is in 64-bit integers and exact: count up to nine billion in a group, a million billion terms.

Defined results: null text, language and source are empty ones, and groups like any other; every row counts as a document, repeated ones too;
a group without terms diverges from others by what the smoothing gives; a language of one source has no pairs; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofact.llm.common import join_by_key, materialise, text_of
from chronofact.shipping import ship

MIN_DOCS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
#: Stripe entries that a task holds before it spills.
HELD = 400_000
#: Stripe entries of a block of terms, or as many as a language has pairs of sources where that is more, and sources whose pairs one task call emits.
BLOCK_ENTRIES = 20_000
BLOCK_SOURCES = 512
_STRIPE = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
#: Bytes of terms with A-Z lower-cased, blanks for all others: every byte of a character beyond ASCII is one of a term.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()
Stripe = dict[str | None, int]


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _rows(stripes: Iterator[tuple[str, str, Stripe]]) -> Iterator[pa.RecordBatch]:
    """Stripes as rows, some thousand at a time; key None of a stripe has its number of documents."""
    held: list[tuple] = []
    for lang, term, stripe in stripes:
        docs = stripe.pop(None)
        held.append((lang, term, docs, list(stripe), list(stripe.values())))
        if len(held) == 20_000:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STRIPE, strict=True)], schema=_STRIPE)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stripes: dict[str, dict[bytes, Stripe]] = {}
    held = 0

    def spill() -> Iterator[pa.RecordBatch]:
        while stripes:
            lang, own = stripes.popitem()
            yield from _rows((lang, term.decode(), stripe) for term, stripe in own.items())

    for batch in batches:
        for text, lang, source in zip(*(batch.column(i) for i in range(3)), strict=True):
            own, source = stripes.setdefault(lang.as_py(), {}), source.as_py()
            for term, n in Counter(terms_of(text.as_py())).items():
                stripe = own.get(term)
                if stripe is None:
                    own[term] = {None: 1, source: n}
                    held += 2
                else:
                    stripe[None] += 1
                    if source in stripe:
                        stripe[source] += n
                    else:
                        stripe[source] = n
                        held += 1
            if held > HELD:
                yield from spill()
                held = 0
    yield from spill()


def _starts(table: pa.Table) -> np.ndarray:
    """Where a new key begins in rows sorted by language and term."""
    new = np.ones(len(table), bool)
    for name in ("lang", "term"):
        column = table.column(name).combine_chunks()
        new[1:] = (new[1:] if name == "term" else False) | pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _summed(table: pa.Table, starts: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """A row for each key: its stripes' counts added by source."""
    owner = np.repeat(np.arange(len(starts)), np.diff([*starts, len(table)]))
    lists = table.column("sources").combine_chunks()
    entry = np.repeat(owner, lists.value_lengths().to_numpy(zero_copy_only=False))
    names = lists.flatten().dictionary_encode()
    where, back = np.unique(entry * max(len(names.dictionary), 1) + names.indices.to_numpy(), return_inverse=True)
    counts = np.zeros(len(where), np.int64)
    np.add.at(counts, back, table.column("counts").combine_chunks().flatten().to_numpy())
    offsets = pa.array(np.searchsorted(where, np.arange(len(starts) + 1) * max(len(names.dictionary), 1)).astype(np.int32))
    sources = names.dictionary.take(pa.array(where % max(len(names.dictionary), 1)))
    at = pa.array(starts)
    columns = [table.column(c).combine_chunks().take(at) for c in ("lang", "term")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(docs), pa.ListArray.from_arrays(offsets, sources), pa.ListArray.from_arrays(offsets, pa.array(counts))], schema=_STRIPE)


def _merge(min_docs: int):  # noqa: ANN202
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stripes added up by key; keys of fewer documents go before their sources are looked at. A key that a batch ends with is carried over as one row."""
        open_key = _STRIPE.empty_table()
        for batch in batches:
            table = pa.concat_tables([open_key, pa.Table.from_batches([batch.cast(_STRIPE) if batch.schema != _STRIPE else batch])])
            if not len(table):
                continue
            starts = _starts(table)
            docs = np.add.reduceat(table.column("docs").to_numpy(), starts)
            if len(starts) > 1:
                yield from _whole(table.slice(0, starts[-1]), starts[:-1], docs[:-1], min_docs)
            open_key = pa.Table.from_batches([_summed(table.slice(starts[-1]), np.zeros(1, int), docs[-1:])])
        if len(open_key):
            yield from _whole(open_key, np.zeros(1, int), open_key.column("docs").to_numpy(), min_docs)

    return merged


def _whole(table: pa.Table, starts: np.ndarray, docs: np.ndarray, min_docs: int) -> Iterator[pa.RecordBatch]:
    kept = docs >= min_docs
    if kept.any():
        sizes = np.diff([*starts, len(table)])
        rows = table.filter(pa.array(np.repeat(kept, sizes)))
        yield _summed(rows, np.cumsum(sizes[kept]) - sizes[kept], docs[kept])


def stripes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """Merged stripes of the kept terms: lang, term, docs, sources, counts. Materialised."""
    ship(docs.sparkSession)
    kind = "lang string, term string, docs bigint, sources array<string>, counts array<bigint>"
    folded = docs.select(text_of(text_col).cast("binary"), text_of(lang_col), text_of(source_col)).mapInArrow(_fold, kind)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(folded.repartition(n, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge(min_docs), kind))


def _emit(top: int):  # noqa: ANN202
    def emit(key: tuple, rows: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        """Of a block of stripes: sums of each pair of sources whose first is in the block of sources, and the foremost terms of each such source."""
        if not len(groups):
            return pd.DataFrame(columns=["lang", "source", "item", "value", "pair"])
        names, totals, kept = list(groups["sources"].iloc[0]), np.array(groups["totals"].iloc[0], np.int64), int(groups["kept"].iloc[0])
        first, last = key[2] * BLOCK_SOURCES, min(len(names), (key[2] + 1) * BLOCK_SOURCES)
        number = {s: i for i, s in enumerate(names)}
        sums, best = np.zeros((last - first, len(names)), np.int64), [[] for _ in range(first, last)]
        p = lambda count, total: 1 + UNIT * (count + 2) // (total + 2 * kept)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        step = max(1, 1_000_000 // len(names))
        for a in range(0, len(rows), step):
            some = rows.iloc[a : a + step]
            counts, terms = np.zeros((len(some), len(names)), np.int64), some["term"].tolist()
            for i, (sources, own) in enumerate(zip(some["sources"], some["counts"], strict=True)):
                counts[i, [number[s] for s in sources]] = own
            each = p(counts, totals[None, :])
            whole = p(counts.sum(1), totals.sum())
            for s in range(first, last):
                sums[s - first, s + 1 :] += f(each[:, s : s + 1], each[:, s + 1 :]).sum(0)
                over = np.flatnonzero((counts[:, s] > 0) & (each[:, s] > whole))
                value = f(each[over, s], whole[over])
                if len(value) > top:  # all that reach the last place
                    there = value >= np.partition(value, -top)[-top]
                    over, value = over[there], value[there]
                best[s - first] = sorted([*best[s - first], *((-int(v), terms[i].encode()) for i, v in zip(over, value, strict=True))])[:top]
        out = [(key[0], names[first + i], term.decode(), -v, False) for i, own in enumerate(best) for v, term in own]
        i, j = np.triu_indices(len(names), 1)
        mine = (i >= first) & (i < last)
        pairs = pd.DataFrame({"lang": key[0], "source": np.array(names, object)[i[mine]], "item": np.array(names, object)[j[mine]], "value": sums[i[mine] - first, j[mine]], "pair": True})
        return pd.concat([pd.DataFrame(out, columns=pairs.columns), pairs]).astype({"value": "int64", "pair": bool})

    return emit


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """lang, source, part, item, value, rank: each other source of the language by divergence, and the `top` terms that a source has more of than its language."""
    merged = stripes(docs, text_col, lang_col, source_col, min_docs)
    there = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source")).distinct()
    counts = merged.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("__e")).groupBy("lang", F.col("__e.sources").alias("source")).agg(F.sum("__e.counts").alias("total"))
    groups = there.join(counts, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0).cast("bigint")).alias("total")))).alias("g"))
    sizes = merged.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.size("sources")).alias("entries"))
    groups = groups.join(sizes, "lang", "left").select("lang", F.col("g.source").alias("sources"), F.col("g.total").alias("totals"), F.coalesce("kept", F.lit(0).cast("bigint")).alias("kept"), (F.floor(F.coalesce("entries", F.lit(0)) / F.greatest(F.lit(block_entries), F.pow(F.size("g"), 2) / 2)) + 1).alias("blocks"))
    groups = materialise(groups.withColumn("spans", F.floor((F.size("sources") - 1) / BLOCK_SOURCES) + 1))
    spread = lambda df: df.withColumn("span", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("spans") - 1)))
    total = groups.agg(F.coalesce(F.sum("kept"), F.lit(0))).first()[0]
    placed = join_by_key(merged, groups.select("lang", "kept", "blocks", "spans"), ["lang"], "kept", total, F.col("term"))
    placed = spread(placed.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))))
    own = spread(groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))))
    out = placed.select("lang", "block", "span", "term", "sources", "counts").groupBy("lang", "block", "span").cogroup(own.select("lang", "block", "span", "sources", "totals", "kept").groupBy("lang", "block", "span"))
    out = materialise(out.applyInPandas(_emit(top), "lang string, source string, item string, value bigint, pair boolean"))
    half = out.filter("pair").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("w")
    pairs = half.select("lang", ways, "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    terms = out.filter("not pair").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))
