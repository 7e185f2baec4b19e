"""Hybrid retrieval for a batch of queries: BM25, query expansion, hashed embeddings, rank fusion, diversity.

Queries are the small side, a stated set; their terms are held by every task, QUERY_BLOCK queries at a time. Facts are read once, into stored indexes (`index.py`); a search scores
the shards that can hold one of the best as matrix products, and only the best of each query leave a shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from chronofact.functions import scoring as S
from chronofact.functions import text as T
from chronofact.operators import facts as O
from chronofact.operators.index import QUERY_BLOCK, StoredIndex, by_blocks, embed, entries, most_promising, vector_of, words_of
from chronofact.shipping import ship
from chronofact.storage import materialise

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
EXPANSION_BOOST = 0.2
POOL = 60
USER_HITS, USER_EXPANDED = 15, 10
SCAN_CAP, MOST_DISTANCE = 512, 1.1
MMR_POOL, MMR_LAMBDA = 24, 0.68


class _Asked:
    """A stated set of queries with weighted terms, QUERY_BLOCK at a time as (names, term to row, weights)."""

    def __init__(self, names: list, weights: list[dict[str, float]]) -> None:
        self.names, self.weights, self.blocks = names, weights, []
        for a in range(0, len(names), QUERY_BLOCK):
            own = weights[a : a + QUERY_BLOCK]
            place = {t: i for i, t in enumerate(sorted({t for w in own for t in w}))}
            matrix = np.zeros((len(place), len(own)))
            for j, w in enumerate(own):
                for t, x in w.items():
                    matrix[place[t], j] = x
            self.blocks.append((np.arange(a, a + len(own)), place, matrix))

    def terms(self) -> list[str]:
        return sorted({t for w in self.weights for t in w})

    def rows(self, spark: SparkSession) -> DataFrame:
        """(q, term, weight), as large as the stated set."""
        rows = [(q, t, x) for q, w in enumerate(self.weights) for t, x in w.items()]
        return spark.createDataFrame(pd.DataFrame(rows, columns=["q", "term", "weight"]).astype({"q": "int32", "term": object, "weight": float}), "q int, term string, weight double")


def _products(own: pd.DataFrame, values: np.ndarray, row: np.ndarray, block: np.ndarray, n: int, asked: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per block of queries: their numbers and the scores, a row a document."""
    terms = own["term"].tolist()
    for queries, place, matrix in asked:
        column = np.array([place.get(t, -1) for t in terms], int)
        x = np.zeros((n, len(place)))
        there = column[block] >= 0 if len(block) else np.zeros(0, bool)
        x[row[there], column[block[there]]] = values[there]
        yield queries, x @ matrix


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, k: int | None = None, among: Column | None = None, least: float | None = None, index: StoredIndex | None = None) -> DataFrame:
    """(query_id, id_col, lex): Okapi BM25 for pairs that share a term, rounded so that equal texts tie; lex counts all of docs. Ids are unique.

    With `among`, a string or an array of strings, only pairs with rows that have a value there, once for each, which is returned as column `among`. With `k`, at
    least the k best pairs, and their ties, of each query and such value; others need not be there. With `least`, those above it. Texts are read from the stored index.
    """
    spark = docs.sparkSession
    index = index or StoredIndex.for_rows(docs.select(id_col, text_col), words_of)
    groups = F.array(F.lit("")) if among is None else among if docs.select(among.alias("x")).schema[0].dataType.typeName() == "array" else F.when(among.isNotNull(), F.array(among.cast("string")))
    live = index.sync(docs, id_col, text_col, groups.alias("groups"))
    asked = queries.select(F.col(query_id).alias("q"), T.words(F.array_join(T.query_terms(F.col(query_text)), " ")).alias("terms")).collect()
    n, total = live.agg(F.count(F.lit(1)), F.sum("length")).first()
    average = float(total or 0) / max(n, 1) or 1.0
    blocks = index.blocks(sorted({t for r in asked for t in r["terms"]}))
    known = blocks.select("term", "shard", F.explode("at").alias("place")).join(live.select("shard", "place"), ["shard", "place"], "left_semi") if n < index.rows("docs").count() else blocks.select("term", F.size("at").alias("n"))
    df = dict(map(tuple, known.groupBy("term").agg(F.sum("n") if "n" in known.columns else F.count(F.lit(1))).collect()))
    idf = {t: max(math.log((n - d + 0.5) / (d + 0.5)), LEAST_IDF) for t, d in df.items()}
    stated = _Asked([r["q"] for r in asked], [{t: idf[t] for t in set(r["terms"]) if t in idf} for r in asked])
    gain = lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
    bounds = materialise(blocks.select("shard", "term", gain(F.col("high"), F.col("shortest")).alias("most")).join(F.broadcast(stated.rows(spark)), "term").groupBy("shard", "q").agg(F.sum(F.col("most") * F.col("weight")).alias("bound")))
    shared = spark.sparkContext.broadcast(stated.blocks)

    def scored(shards: DataFrame, floors: dict[tuple[int, str], float]) -> DataFrame:
        def score(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            row, block, tf = entries(own, rows)
            ids, lengths, groups, out = rows["id"].to_numpy(object), rows["length"].to_numpy(float), rows["groups"].tolist(), []
            member = {g: np.array([x is not None and g in x for x in groups]) for g in {g for x in groups if x is not None for g in x}}
            for numbers, scores in _products(own, gain(tf, lengths[row]), row, block, len(rows), shared.value):
                lex = np.round(scores, 6)
                for g, mine in member.items():
                    found = (scores > 0) & mine[:, None] & (lex >= np.array([floors.get((int(q), g), -1.0) for q in numbers]))
                    if least is not None:
                        found &= lex > least
                    if k is not None and mine.sum() > k:
                        found &= lex >= np.partition(np.where(mine[:, None], lex, -1.0), len(rows) - k, axis=0)[len(rows) - k]
                    i, j = np.nonzero(found)
                    out.append(pd.DataFrame({"q": numbers[j], "id": ids[i], "lex": lex[i, j], "among": g}))
            return pd.concat(out) if out else pd.DataFrame(columns=["q", "id", "lex", "among"])

        there = F.broadcast(shards)
        return by_blocks(blocks.join(there, "shard", "left_semi"), live.join(there, "shard", "left_semi").select("shard", "place", "id", "length", "groups"), score, "q int, id string, lex double, among string")

    if k is None:
        hits = scored(bounds.filter(F.col("bound") >= (least or 0.0)).select("shard").distinct(), {})
    else:
        first = materialise(most_promising(bounds))
        best = materialise(scored(first, {}))
        order = W.partitionBy("q", "among").orderBy(F.desc("lex"))
        floors = {(r["q"], r["among"]): r["lex"] for r in best.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") == k).collect()}
        kinds = [r[0] for r in live.select(F.explode("groups")).distinct().collect()] if among is not None else [""]
        lowest = [(q, min(floors.get((q, g), 0.0) for g in kinds)) for q in range(len(asked))] if kinds else []
        rest = bounds.join(F.broadcast(spark.createDataFrame(lowest, "q int, floor double")), "q").filter(F.col("bound") >= F.col("floor") - 1e-5)
        hits = best.unionByName(scored(rest.join(first, "shard", "left_anti").select("shard").distinct(), floors))
    kinds = {f.name: f.dataType for f in [*queries.schema, *docs.schema]}
    names = spark.createDataFrame(list(enumerate(stated.names)), StructType([StructField("__asked", IntegerType()), StructField(query_id, kinds[query_id])]))
    pairs = hits.withColumnRenamed("q", "__asked").join(F.broadcast(names), "__asked").select(query_id, F.col("id").cast(kinds[id_col]).alias(id_col), "lex", "among")
    return pairs if among is not None else pairs.drop("among")


def nearest(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, k: int, index: StoredIndex | None = None) -> DataFrame:
    """(query_id, id_col, dist, rank): of all docs, those that share nothing with the query too, the k nearest by embedding, ties by id.

    A shard's bound is the least distance that its blocks' extremes allow.
    """
    spark = docs.sparkSession
    index = index or StoredIndex.for_rows(docs.select(id_col, text_col), vector_of, forward=True)
    live = index.sync(docs, id_col, text_col)
    asked = queries.select(F.col(query_id).alias("q"), F.coalesce(F.col(query_text), F.lit("")).alias("t")).collect()
    stated = _Asked([r["q"] for r in asked], [{str(d): v for d, v in zip(*embed(r["t"], {}), strict=True)} for r in asked])
    blocks = index.blocks(stated.terms())
    most = F.greatest(F.col("weight") * F.col("high"), F.col("weight") * F.col("low"), F.lit(0.0))
    bounds = materialise(blocks.select("shard", "term", "high", "low").join(F.broadcast(stated.rows(spark)), "term").groupBy("shard", "q").agg(F.sum(most).alias("bound")))
    shared = spark.sparkContext.broadcast(stated.blocks)

    def scored(shards: DataFrame, floors: dict[int, float]) -> DataFrame:
        def score(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("id").reset_index(drop=True)
            row, block, value = entries(own, rows)
            ids, out = rows["id"].to_numpy(object), []
            for numbers, dots in _products(own, value, row, block, len(rows), shared.value):
                dist = np.round(1 - dots, 6)
                for j, q in enumerate(numbers):
                    best = np.argsort(dist[:, j], kind="stable")[:k]
                    best = best[dist[best, j] <= floors.get(int(q), np.inf)]
                    out.append(pd.DataFrame({"q": q, "id": ids[best], "dist": dist[best, j]}))
            return pd.concat(out) if out else pd.DataFrame(columns=["q", "id", "dist"])

        there = F.broadcast(shards)
        return by_blocks(blocks.join(there, "shard", "left_semi"), live.join(there, "shard", "left_semi").select("shard", "place", "id"), score, "q int, id string, dist double")

    first = materialise(most_promising(bounds))
    best = materialise(scored(first, {}))
    order = W.partitionBy("q").orderBy("dist", "id")
    floors = {r["q"]: r["dist"] for r in best.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") == k).collect()}
    reach = [(q, floors.get(q, 2.0)) for q in range(len(asked))]
    rest = bounds.join(F.broadcast(spark.createDataFrame(reach, "q int, floor double")), "q").filter(1 - F.col("bound") <= F.col("floor") + 1e-5).select("shard")
    if any(floor >= 1 for _, floor in reach):  # a document that shares no dimension is at 1
        rest = live.select("shard")
    hits = best.unionByName(scored(rest.join(first, "shard", "left_anti").distinct(), floors)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    kinds = {f.name: f.dataType for f in [*queries.schema, *docs.schema]}
    names = spark.createDataFrame(list(enumerate(stated.names)), StructType([StructField("__asked", IntegerType()), StructField(query_id, kinds[query_id])]))
    return hits.withColumnRenamed("q", "__asked").join(F.broadcast(names), "__asked").select(query_id, F.col("id").cast(kinds[id_col]).alias(id_col), "dist", "rank")


def top_k(scored: DataFrame, by: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return scored.withColumn(rank, F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col(rank) <= k)


def top_lexical(scored: DataFrame, facts: DataFrame, query_id: str, id_col: str, k: int, rank: str = "rank") -> DataFrame:
    """The first k of each query by lex, then the facts' `key`, then id, with the facts' columns.

    All but the k best and their ties go before the facts, with their long keys, are met.
    """
    few = scored.join(facts.select(id_col), id_col, "left_semi").withColumn("__r", F.rank().over(W.partitionBy(query_id).orderBy(F.desc("lex")))).filter(F.col("__r") <= k).drop("__r")
    return top_k(few.join(facts, id_col), query_id, [F.desc("lex"), F.col("key"), F.col(id_col)], k, rank)


def embedded(df: DataFrame, text_col: str) -> DataFrame:
    """df with dims and values of the text's embedding."""
    ship(df.sparkSession)

    @F.pandas_udf("dims array<int>, values array<double>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, int]] = {}
        for texts in parts:
            if len(known) > 1_000_000:
                known.clear()
            yield pd.DataFrame([embed(t or "", known) for t in texts], columns=["dims", "values"])

    return df.withColumn("__v", vectors(text_col)).select(*df.columns, "__v.dims", "__v.values")


def sparse_embedding(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, dim, value): the hashed embedding's non-zero entries."""
    return embedded(df.select(id_col, text_col), text_col).select(id_col, F.explode(F.arrays_zip("dims", "values")).alias("e")).select(id_col, F.col("e.dims").alias("dim"), F.col("e.values").alias("value"))


def pool_distances(pool: DataFrame, docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, index: StoredIndex | None = None) -> DataFrame:
    """(query_id, id_col, dist): cosine distance for pooled pairs alone, from the stored embeddings; a pair that shares no dimension is at 1."""
    index = index or StoredIndex.for_rows(docs.select(id_col, text_col), vector_of, forward=True)
    kind = docs.schema[id_col].dataType
    pairs = pool.select(query_id, id_col)
    d = index.sync(docs, id_col, text_col).select(F.col("id").cast(kind).alias(id_col), "dims", "values")
    d = d.join(pairs.select(id_col).distinct(), id_col, "left_semi")
    q = embedded(queries.select(query_id, query_text), query_text).select(query_id, F.col("dims").alias("q_dims"), F.col("values").alias("q_values"))

    @F.pandas_udf("double")
    def distance(dims: pd.Series, values: pd.Series, q_dims: pd.Series, q_values: pd.Series) -> pd.Series:
        out = []
        for a, x, b, y in zip(dims, values, q_dims, q_values, strict=True):
            _, i, j = np.intersect1d(a, b, return_indices=True)
            out.append(round(1.0 - float(np.asarray(x)[i] @ np.asarray(y)[j]), 6))
        return pd.Series(out)

    return pairs.join(d, id_col).join(q, query_id).select(query_id, id_col, distance("dims", "values", "q_dims", "q_values").alias("dist"))


def with_expansions(queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """(query_id, asked, text): each query as it is, asked 0, and the texts that its triggers add."""
    texts = F.concat(F.array(F.col(query_text)), T.expansions(F.col(query_text)))
    return queries.select(query_id, F.posexplode(texts).alias("asked", "text"))


def scope_passes(user: str, workspace: str | None, session: str | None) -> Column:
    """The passes that search a fact: its workspace's, its session's, its user's. Of active facts; visibility is asked of their hits."""
    of = [F.when(O.scope_clause(user=user), F.lit("user"))]
    if workspace is not None:
        of.append(F.when(O.scope_clause(user=user, workspace=workspace), F.lit("workspace")))
        if session is not None:
            of.append(F.when(O.scope_clause(user=user, workspace=workspace, session=session), F.lit("session")))
    return F.when(F.col("status") == "active", F.array_compact(F.array(*of)))


def candidates(facts: DataFrame, queries: DataFrame, query_id: str, query_text: str, k: int = POOL, index: StoredIndex | None = None) -> DataFrame:
    """(query_id, fact_id, key, lex, answer): in each pass the k best facts of each query and each of its expansions, of the user's pass USER_HITS and USER_EXPANDED; of
    these the eligible. The strongest hit counts, one of an expansion by EXPANSION_BOOST more.

    facts: fact_id, key (tie-break), index_text, passes, eligible.
    """
    texts = with_expansions(queries, query_id, query_text).withColumn("__part", F.struct(query_id, "asked"))
    numbered = materialise(texts.withColumn("__q", F.row_number().over(W.orderBy(query_id, "asked"))).drop("__part"))  # one row a text of a stated set of queries
    hits = bm25(facts, numbered, "fact_id", "index_text", "__q", "text", k, F.col("passes"), index=index)
    few = hits.withColumn("__r", F.rank().over(W.partitionBy("__q", "among").orderBy(F.desc("lex")))).filter(F.col("__r") <= k).drop("__r")
    met = few.join(facts.select("fact_id", "key", "eligible"), "fact_id").withColumn("__r", F.row_number().over(W.partitionBy("__q", "among").orderBy(F.desc("lex"), "key", "fact_id")))
    met = met.join(F.broadcast(numbered.select("__q", query_id, "asked")), "__q").withColumn("answer", (F.col("asked") > 0).cast("int"))
    most = F.when(F.col("among") == "user", F.least(F.lit(k), F.when(F.col("answer") == 1, USER_EXPANDED).otherwise(USER_HITS))).otherwise(k)
    met = met.filter((F.col("__r") <= most) & F.col("eligible"))
    return met.groupBy(query_id, "fact_id").agg(F.first("key").alias("key"), F.max(F.col("lex") + F.col("answer") * EXPANSION_BOOST).alias("lex"), F.max("answer").alias("answer"))


def with_fill(pool: DataFrame, facts: DataFrame, queries: DataFrame, query_id: str) -> DataFrame:
    """The pool and, for queries that say `broad` (events of an empty context), the user's eligible active facts, below real hits by fixed values.

    facts: fact_id, key, fill (the value, null for facts that don't fill), eligible, user_id. queries: query_id, broad, user_id. A fact meets its own user's queries.
    """
    own = facts.filter("eligible AND fill IS NOT NULL").select("user_id", "fact_id", "key", F.col("fill").alias("lex"))
    broad = queries.filter("broad").select(query_id, "user_id")
    both = pool.unionByName(own.join(F.broadcast(broad), "user_id").select(query_id, "fact_id", "key", "lex", F.lit(0).alias("answer")))
    return both.groupBy(query_id, "fact_id").agg(F.first("key").alias("key"), F.max("lex").alias("lex"), F.max("answer").alias("answer"))


def fill_value(workspace: str | None, session: str | None) -> Column:
    """What an active fact counts in a broad fill: 0.5 in the workspace's session, 0.45 if it is its user's everywhere, 0.3 in the workspace."""
    here = F.col("workspace_id") == F.lit(workspace)
    return F.when(F.col("status") == "active", F.when(here & (F.col("session_id") == F.lit(session)), 0.5).when(F.col("workspace_id").isNull() & F.col("session_id").isNull(), 0.45).when(here, 0.3))


def semantic_expansion(pool: DataFrame, facts: DataFrame, queries: DataFrame, query_id: str, query_text: str, k: int = POOL, index: StoredIndex | None = None) -> DataFrame:
    """(query_id, fact_id, key, dist): for queries whose pool holds less than k, the eligible facts of the SCAN_CAP nearest of all that are
    within MOST_DISTANCE and not in the pool, as many as are wanting, nearest first, ties by id.
    """
    held = queries.select(query_id, query_text).join(pool.groupBy(query_id).agg(F.count(F.lit(1)).alias("held")), query_id, "left").withColumn("held", F.coalesce("held", F.lit(0)))
    short = materialise(held.filter(F.col("held") < k))
    near = nearest(facts, short, "fact_id", "semantic_text", query_id, query_text, SCAN_CAP, index).filter(F.col("dist") <= MOST_DISTANCE)
    near = near.join(facts.filter("eligible").select("fact_id", "key"), "fact_id").join(pool.select(query_id, "fact_id"), [query_id, "fact_id"], "left_anti")
    near = near.withColumn("__r", F.row_number().over(W.partitionBy(query_id).orderBy("rank"))).join(F.broadcast(short.select(query_id, "held")), query_id)
    return near.filter(F.col("__r") <= k - F.col("held")).select(query_id, "fact_id", "key", "dist")


def pools(facts: DataFrame, queries: DataFrame, query_id: str, query_text: str, k: int = POOL, words: StoredIndex | None = None, vectors: StoredIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """The two lists: (query_id, fact_id, key, lex, answer) by words, broad fill included, and (query_id, fact_id, key, dist) by meaning, expansion included."""
    pool = candidates(facts, queries, query_id, query_text, k, words)
    pool = materialise(with_fill(pool, facts, queries, query_id) if "broad" in queries.columns else pool)
    saying = queries.filter(F.col(query_text) != "")  # an empty query means nothing
    near = pool_distances(pool, facts, saying, "fact_id", "semantic_text", query_id, query_text, vectors).join(pool.select(query_id, "fact_id", "key"), [query_id, "fact_id"])
    return pool, materialise(near.select(query_id, "fact_id", "key", "dist").unionByName(semantic_expansion(pool, facts, saying, query_id, query_text, k, vectors)))


def retrieve(facts: DataFrame, queries: DataFrame, query_id: str, query_text: str, session: Column, now_ms: Column, k: int = POOL, words: StoredIndex | None = None, vectors: StoredIndex | None = None) -> DataFrame:
    """(query_id, fact_id, key, lex, dist, rank_l, rank_s, rrf, entity, answer, score, rank): passes by scope with expansions, broad fill, short pools filled
    by meaning; both lists ranked, fused and weighed. Facts that aren't `valid` go after the ranks are given; a fact may be in one list alone.

    facts: fact_id, key, index_text, semantic_text, passes, eligible, valid, confidence, t_recorded, workspace_id, session_id, promotion_state and, for broad queries, fill and
    user_id. queries: query_id, query_text, entities, and broad and user_id or neither. `words` and `vectors` are stored indexes of index_text and semantic_text.
    """
    pool, near = pools(facts, queries, query_id, query_text, k, words, vectors)
    both = fused(pool.select(query_id, "fact_id", "key", "lex"), near, query_id, "fact_id", "key")
    met = both.join(pool.select(query_id, "fact_id", "answer"), [query_id, "fact_id"], "left").withColumn("answer", F.coalesce("answer", F.lit(0)))
    met = met.join(F.broadcast(queries.select(query_id, "entities")), query_id)
    met = met.join(facts.join(both.select("fact_id").distinct(), "fact_id", "left_semi").select("fact_id", "key", "semantic_text", "valid", "confidence", "t_recorded", "workspace_id", "session_id", "promotion_state"), "fact_id").filter("valid")
    met = met.withColumn("entity", entity_overlap(F.col("entities"), F.col("semantic_text")))
    scope = S.scope_weight(F.col("session_id"), F.col("workspace_id"), F.col("promotion_state"), session)
    met = met.withColumn("score", F.round(final_score(F.col("rrf"), scope, F.col("entity"), F.col("answer"), F.col("confidence"), F.col("t_recorded"), now_ms), 8))
    met = met.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("score"), "key", "fact_id")))
    return met.select(query_id, "fact_id", "key", "lex", "dist", "rank_l", "rank_s", "rrf", "entity", "answer", "score", "rank")


def fused(lexical: DataFrame, semantic: DataFrame, query_id: str, id_col: str, key: str) -> DataFrame:
    """Full outer join of (query, id, key, lex) and (query, id, key, dist) with the ranks in either list and their RRF. Ranks come before any validity filter."""
    by = W.partitionBy(query_id)
    a = lexical.select(query_id, id_col, key, "lex", F.row_number().over(by.orderBy(F.desc("lex"), key, id_col)).alias("rank_l"))
    b = semantic.select(query_id, id_col, key, "dist", F.row_number().over(by.orderBy("dist", key, id_col)).alias("rank_s"))
    both = a.drop(key).join(b.drop(key), [query_id, id_col], "full_outer")
    return both.withColumn("rrf", S.rrf(F.col("rank_l"), F.col("rank_s")))


def mmr(ranked: DataFrame, vectors: DataFrame, query_id: str, id_col: str, pool: int = MMR_POOL, lam: float = MMR_LAMBDA) -> DataFrame:
    """Maximal marginal relevance over the first `pool` of each query; the tail keeps its order.

    ranked: query_id, id_col, rank, score. vectors: id_col, dim, value. Only pools meet vectors; a group is one query's pool.
    """
    ship(ranked.sparkSession)
    heads, tail = ranked.filter(F.col("rank") <= pool), ranked.filter(F.col("rank") > pool)
    packed = vectors.join(heads.select(id_col).distinct(), id_col, "left_semi").groupBy(id_col).agg(F.collect_list(F.struct("dim", "value")).alias("vec"))
    kind = {f.name: f.dataType.simpleString() for f in ranked.schema}

    def reorder(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        vecs = [{e["dim"]: e["value"] for e in (v if v is not None else [])} for v in group["vec"]]
        like = lambda a, b: min(1.0, max(0.0, sum(x * vecs[b].get(d, 0.0) for d, x in vecs[a].items())))
        best = max(group["score"].max(), 1e-12)
        left, chosen, near = list(range(len(group))), [], [0.0] * len(group)
        while left:
            pick = max(left, key=lambda i: (round(lam * group["score"][i] / best - (1 - lam) * near[i], 9), -i))
            left.remove(pick)
            chosen.append(pick)
            for i in left:
                near[i] = max(near[i], like(pick, i))
        out = group.loc[chosen, [query_id, id_col, "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    head = heads.join(packed, id_col, "left").groupBy(query_id).applyInPandas(reorder, f"{query_id} {kind[query_id]}, {id_col} {kind[id_col]}, score double, rank int")
    return head.unionByName(tail.select(query_id, id_col, "score", F.col("rank").cast("int").alias("rank")))


def final_score(rrf: Column, scope: Column, entity: Column, answer: Column, confidence: Column, t_ms: Column, now_ms: Column) -> Column:
    return rrf * scope * (1 + 0.5 * entity) * (1 + 0.35 * answer) * S.confidence_factor(confidence) * S.recency(t_ms, now_ms)


def entity_overlap(entities: Column, haystack: Column) -> Column:
    """Share of the entities that the text holds; 0 without entities."""
    low = F.lower(haystack)
    return F.when(F.size(entities) > 0, F.size(F.filter(entities, lambda e: F.contains(low, F.lower(e)))) / F.size(entities)).otherwise(0.0)


def _near(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, keep: int | None, max_distance: float | None) -> DataFrame:
    """(query_id, id_col, dist) of the `keep` nearest of each batch, or (query_id, dist, n): the least distance and the number of vectors within the bound of each batch.

    Queries, a stated set, are matrices of QUERY_BLOCK that every task holds: a batch of vectors is one product with each.
    """
    ship(vectors.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}[id_col]
    held = queries.select(id_col, vec_col).collect()
    blocks = []
    for at in range(0, len(held), QUERY_BLOCK):
        own = np.array([r[vec_col] for r in held[at : at + QUERY_BLOCK]], dtype=np.float64)
        blocks.append((np.array([r[id_col] for r in held[at : at + QUERY_BLOCK]]), (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-300)).T))
    shared, most = vectors.sparkSession.sparkContext.broadcast(blocks), np.inf if max_distance is None else max_distance

    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            own, ids = np.stack(part[vec_col].to_list()).astype(np.float64), part[id_col].to_numpy()
            norms = np.linalg.norm(own, axis=1, keepdims=True)
            for names, matrix in shared.value:
                dist = np.where(norms > 0, np.round(1 - (own / np.maximum(norms, 1e-300)) @ matrix, 6), 1.0)
                there = (ids[:, None] != names[None, :]) & (dist <= most)
                for j, name in enumerate(names):
                    i = np.flatnonzero(there[:, j])
                    if keep is None:
                        yield pd.DataFrame({"query_id": [name], "dist": [dist[i, j].min() if len(i) else np.nan], "n": [len(i)]})
                    else:
                        best = i[np.lexsort((ids[i], dist[i, j]))[:keep]]
                        yield pd.DataFrame({"query_id": name, id_col: ids[best], "dist": dist[best, j]})

    return vectors.select(id_col, vec_col).mapInPandas(nearest, f"query_id {kind}, dist double, n bigint" if keep is None else f"query_id {kind}, {id_col} {kind}, dist double")


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", max_distance: float | None = None) -> DataFrame:
    """(query_id, id_col, dist, rank): exact k nearest by cosine, the query itself left out. k of each query leave a batch."""
    return top_k(_near(vectors, queries, id_col, vec_col, k, max_distance), "query_id", [F.col("dist"), F.col(id_col)], k)


def within(vectors: DataFrame, queries: DataFrame, max_distance: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, n, nearest): how many vectors are within the distance of each query, and the least distance; counted where the vectors lie."""
    found = _near(vectors, queries, id_col, vec_col, None, max_distance)
    return found.groupBy("query_id").agg(F.sum("n").alias("n"), F.min(F.nanvl("dist", F.lit(None).cast("double"))).alias("nearest")).filter("n > 0")
