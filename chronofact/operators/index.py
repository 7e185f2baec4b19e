"""A stored inverted index over texts: words for BM25, hashed dimensions for nearest neighbours.

Texts are read into shards of at most SHARD_DOCS by the task that holds them. A shard has a row a document and, for each term, a block: which of
its documents have the term, their values, the highest and the lowest value and the shortest length. Blocks lie sorted by
term, so that a search reads those of its own terms. A text is known by its id and hash: `sync` reads only those that aren't there yet and appends them
as a segment, which is seen when it is whole or not at all; what the given rows no longer hold is passed over.

A search bounds what each shard can score by its blocks' extremes, scores the shards that promise most, and after that only
those whose bound reaches the k-th best score so far. Nothing that could be among the best is passed over.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.functions import text as T
from chronofact.shipping import ship
from chronofact.storage import materialise, shared_folder

SHARD_DOCS, SHARD_ENTRIES = 1024, 1_000_000
QUERY_BLOCK = 256
#: A search names its terms in the filter that goes to the files up to so many; more come by a broadcast of the stated queries' terms.
NAMED_TERMS = 1000
DIM = 1536
CONCEPT_WEIGHT = 3
_ROW = "kind string, shard string, term string, at array<int>, value array<double>, high double, low double, shortest int, id string, hash bigint, place int, length int, dims array<int>, values array<double>"
#: terms, values, length, whether a document's row carries them too.
Features = tuple[list, list[float], int]


def words_of(text: str, known: dict) -> Features:
    """Index terms, runs of a-z and 0-9 of the lower-cased text, with their counts; the length is the number of all."""
    words = re.findall("[a-z0-9]+", text.lower())
    own = Counter(words)
    return list(own), [*map(float, own.values())], len(words)


def embed(text: str, known: dict[str, tuple[int, int]]) -> tuple[list[int], list[float]]:
    """Dimensions and values of the hashed embedding, of unit length. Tokens count once each time, concepts CONCEPT_WEIGHT. `known` remembers features."""
    low = text.lower()
    own = Counter(t for t in re.split(T.TERM_BREAK, low) if len(t) >= 2)
    for name, terms in T.CONCEPTS:
        if any(t in low if " " in t else t in own for t in terms):
            own[f"concept:{name}"] += CONCEPT_WEIGHT
    out: dict[int, int] = {}
    for feature, n in own.items():
        if feature not in known:
            h = 2166136261
            for c in feature:
                h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
            known[feature] = h % DIM, -1 if h >= 1 << 31 else 1
        dim, sign = known[feature]
        out[dim] = out.get(dim, 0) + sign * n
    out = {d: v for d, v in out.items() if v}
    norm = sum(v * v for v in out.values()) ** 0.5
    return list(out), [v / norm for v in out.values()]


def vector_of(text: str, known: dict) -> Features:
    dims, values = embed(text, known)
    return dims, values, len(dims)


def _inverted(features: Callable[[str, dict], Features], segment: str, forward: bool, most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [x.split()[0] for x in _ROW.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, number, known = TaskContext.get().partitionId(), 0, {}
        docs, blocks, held = [], {}, 0

        def whole() -> pd.DataFrame:
            shard, rows = f"{segment}-{task}-{number}", []
            for place, (i, h, length, own) in enumerate(docs):
                rows.append(("docs", shard, None, None, None, None, None, None, i, h, place, length, *(own if forward else (None, None))))
            for term, found in blocks.items():
                at, value = zip(*found, strict=True)
                rows.append(("terms", shard, str(term), list(at), list(value), max(value), min(value), min(docs[a][2] for a in at), None, None, None, None, None, None))
            return pd.DataFrame(rows, columns=names, dtype=object).astype({"shortest": "Int32", "hash": "Int64", "place": "Int32", "length": "Int32"})

        for part in parts:
            for i, h, text in zip(part["id"], part["hash"], part["text"], strict=True):
                if len(known) > 1_000_000:
                    known.clear()
                terms, values, length = features(text, known)
                for term, value in zip(terms, values, strict=True):
                    blocks.setdefault(term, []).append((len(docs), value))
                docs.append((i, int(h), length, (terms, values) if forward else None))
                held += len(terms)
                if len(docs) == most or held > SHARD_ENTRIES:
                    yield whole()
                    docs, blocks, held, number = [], {}, 0, number + 1
        if docs:
            yield whole()

    return run


class StoredIndex:
    """An index in a folder that driver and executors share. `features` reads a text; with `forward`, a document's row carries its own terms, as numbers."""

    def __init__(self, spark: SparkSession, folder: str, features: Callable[[str, dict], Features], forward: bool = False, shard_docs: int = SHARD_DOCS) -> None:
        self.spark, self.folder, self.features, self.forward, self.shard_docs = spark, folder.rstrip("/"), features, forward, shard_docs
        self.read_texts = 0

    @classmethod
    def for_rows(cls, docs: DataFrame, features: Callable[[str, dict], Features], forward: bool = False) -> StoredIndex:
        """The index in the shared folder for what these rows are read from; as `sync` compares rows, another corpus of the same name does no harm."""
        name = hashlib.sha256(f"{docs.semanticHash()} {features.__name__}".encode()).hexdigest()[:16]
        return cls(docs.sparkSession, f"{shared_folder(docs.sparkSession)}/index-{name}", features, forward)

    def _segments(self) -> list[str]:
        """Whole segments; one whose writing was broken off has no mark of success and isn't seen."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(path):
            return []
        found = [s.getPath() for s in files.listStatus(path)]
        return sorted(p.toString() for p in found if p.getName().startswith("segment=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def rows(self, kind: str) -> DataFrame:
        segments = self._segments()
        empty = self.spark.createDataFrame([], _ROW)
        out = self.spark.read.schema(_ROW).option("basePath", self.folder).parquet(*segments).select(*empty.columns) if segments else empty
        return out.filter(F.col("kind") == kind)

    def sync(self, docs: DataFrame, id_col: str, text_col: str, *columns: Column) -> DataFrame:
        """Read the texts that aren't there yet. The given rows with their places: shard, place, id, hash, length, dims, values and the columns.

        Ids are unique and not null. A second call over the same rows reads no text but for its hash.
        """
        ship(self.spark)
        text = F.coalesce(F.col(text_col), F.lit(""))
        given = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text, F.octet_length(text)).alias("hash"), text.alias("text"), *columns)
        there = self.rows("docs").select("id", "hash")
        new = given.select("id", "hash", "text")
        self.read_texts = 0
        if self._segments():
            missing = materialise(given.select("id", "hash").join(there, ["id", "hash"], "left_anti"))
            self.read_texts = missing.count()
            new = new.join(missing, ["id", "hash"], "left_semi")
        if not self._segments() or self.read_texts:
            segment = uuid.uuid4().hex
            out = new.mapInPandas(_inverted(self.features, segment, self.forward, self.shard_docs), _ROW).sortWithinPartitions("kind", "term", "shard")
            out.write.partitionBy("kind").parquet(f"{self.folder}/segment={segment}")
            self.read_texts = self.read_texts or self.rows("docs").count()
        return materialise(given.drop("text").join(self.rows("docs").select("id", "hash", "shard", "place", "length", "dims", "values"), ["id", "hash"]))

    def blocks(self, terms: list[str]) -> DataFrame:
        """The blocks of these terms."""
        rows = self.rows("terms").select("shard", "term", "at", "value", "high", "low", "shortest")
        if len(terms) <= NAMED_TERMS:
            return rows.filter(F.col("term").isin(terms))
        named = self.spark.createDataFrame(pd.DataFrame({"term": terms}))
        return rows.filter(F.col("term").between(min(terms), max(terms))).join(F.broadcast(named), "term", "left_semi")


def by_blocks(blocks: DataFrame, live: DataFrame, score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """score(a shard's blocks, its rows) for each shard of `live`."""
    none = pd.DataFrame(columns=[x.split()[0] for x in schema.split(", ")])

    def run(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return score(own, rows) if len(rows) else none

    return blocks.groupBy("shard").cogroup(live.groupBy("shard")).applyInPandas(run, schema)


def most_promising(bounds: DataFrame, n: int = 1) -> DataFrame:
    """(shard): of each query `q` the `n` shards with the greatest bound."""
    return bounds.withColumn("__r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("bound"), "shard"))).filter(F.col("__r") <= n).select("shard").distinct()


def entries(own: pd.DataFrame, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's blocks: row, block and value of each entry whose document is among the rows."""
    size = own["at"].map(len).to_numpy(int) if len(own) else np.zeros(0, int)
    at, value = (np.concatenate([np.zeros(0), *own[c]]) for c in ("at", "value")) if len(own) else (np.zeros(0), np.zeros(0))
    where = np.full(max(int(at.max(initial=0)), int(rows["place"].max())) + 1, -1)
    where[rows["place"].to_numpy(int)] = np.arange(len(rows))
    row, block = where[at.astype(int)], np.repeat(np.arange(len(own)), size)
    kept = row >= 0
    return row[kept], block[kept], value[kept]
