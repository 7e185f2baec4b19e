"""The stored index against brute force, and retrieval by meaning alone."""

from __future__ import annotations

import math
import random
import re
import uuid
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronofact.api import FactStore
from chronofact.operators import retrieve as R
from chronofact.operators.index import StoredIndex, embed, vector_of, words_of
from chronofact.storage import shared_folder

WORDS = [f"w{i}" for i in range(40)] + ["pnpm", "sqlite", "jest"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(f"f{i:03d}", " ".join(rng.choices(WORDS, weights=[40 // (j % 40 + 1) + 1 for j in range(len(WORDS))], k=rng.randint(0, 30)))) for i in range(n)]


def folder(spark):
    return f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"


def brute_bm25(docs, query):
    words = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in docs}
    n, average = len(docs), sum(map(len, words.values())) / len(docs)
    out = {}
    for i, own in words.items():
        tf, score = Counter(own), 0.0
        for t in set(query.split()):
            df = sum(t in x for x in words.values())
            if tf[t]:
                score += max(math.log((n - df + 0.5) / (df + 0.5)), R.LEAST_IDF) * tf[t] * (R.K1 + 1) / (tf[t] + R.K1 * (1 - R.B + R.B * len(own) / average))
        if score > 0:
            out[i] = round(score, 6)
    return out


@pytest.mark.parametrize("k", [1, 5, 60])
def test_bm25_passes_over_nothing_that_counts(spark, k):
    docs = texts(150)
    frame = spark.createDataFrame(docs, "id string, text string").repartition(3).withColumn("groups", F.when(F.col("id") < "f120", F.array(F.lit("all"), F.when(F.col("id") < "f010", F.lit("few")).otherwise(F.lit("rest")))))
    asked = [(i, q) for i, q in enumerate(["w1 w2 w39", "w38", "pnpm sqlite", "nothing known", "w0 w1 w2 w3"])]
    queries = spark.createDataFrame(asked, "q int, text string")
    index = StoredIndex(spark, folder(spark), words_of, shard_docs=7)
    got = R.bm25(frame, queries, "id", "text", "q", "text", k, F.col("groups"), index=index).collect()
    assert index.read_texts == 150
    for q, text in asked:
        scores = brute_bm25(docs, text)
        for group, member in (("all", lambda i: i < "f120"), ("few", lambda i: i < "f010"), ("rest", lambda i: "f010" <= i < "f120")):
            want = sorted((x for i, x in scores.items() if member(i)), reverse=True)[:k]
            own = {r["id"]: r["lex"] for r in got if r["q"] == q and r["among"] == group}
            assert all(abs(own[i] - scores[i]) < 2e-6 for i in own)
            assert sorted(own.values(), reverse=True)[: len(want)] == pytest.approx(want, abs=2e-6)


def test_index_reads_what_is_new(spark):
    docs, where = texts(60), folder(spark)
    queries = spark.createDataFrame([(0, "w1 w5 w30"), (1, "fresh words")], "q int, text string")

    def search(rows):
        index = StoredIndex(spark, where, words_of, shard_docs=16)
        hits = R.bm25(spark.createDataFrame(rows, "id string, text string"), queries, "id", "text", "q", "text", index=index).collect()
        for q, text in ((0, "w1 w5 w30"), (1, "fresh words")):
            assert {r["id"]: r["lex"] for r in hits if r["q"] == q} == pytest.approx(brute_bm25(rows, text), abs=2e-6)
        return index.read_texts

    assert search(docs) == 60
    assert search(docs) == 0
    changed = [(i, "fresh words w1" if i == "f007" else t) for i, t in docs]
    assert search(changed) == 1
    assert search(changed[10:]) == 0  # ten are gone and count no more
    # A segment whose writing was broken off isn't seen.
    broken = Path(where.removeprefix("file:")) / "segment=broken" / "kind=docs"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"half")
    assert search(docs) == 0


@pytest.mark.parametrize("k", [1, 10, 70])
def test_nearest_is_exact(spark, k):
    docs = texts(90, seed=2)
    asked = ["w1 w2 w39", "mocha", "zzz unheard", "pnpm yarn", ""]
    frame, queries = spark.createDataFrame(docs, "id string, text string").repartition(3), spark.createDataFrame(list(enumerate(asked)), "q int, text string")
    got = R.nearest(frame, queries, "id", "text", "q", "text", k, StoredIndex(spark, folder(spark), vector_of, forward=True, shard_docs=7)).collect()
    for q, text in enumerate(asked):
        a = dict(zip(*embed(text, {}), strict=True))
        dist = sorted((round(1 - sum(v * a.get(d, 0) for d, v in zip(*embed(t, {}), strict=True)), 6), i) for i, t in docs)[:k]
        assert [(r["id"]) for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] == [i for _, i in dist]


FACT = {"status": "active", "promotion_state": "workspace_active", "trust_tier": "high", "user_id": "u", "workspace_id": "w", "t_recorded": 0, "fact_kind": "semantic"}


def test_found_by_meaning_alone(spark, tmp_path):
    """No word of the query stands in the fact."""
    store = FactStore(spark, str(tmp_path))
    rows = [FACT | {"fact_id": f"noise{i:02d}", "subject": f"aaa-noise-{i:02d}", "predicate": "owner", "object_str": f"cache layer {i}", "raw_quote": f"cache layer {i} is owned by the platform team"} for i in range(24)]
    rows.append(FACT | {"fact_id": "gold", "subject": "zzzz-incident-policy", "predicate": "escalation_target", "object_str": "pagerduty", "raw_quote": "pagerduty owns production escalation", "fact_kind": "constraint"})
    rows.append(rows[-1] | {"fact_id": "elsewhere", "workspace_id": "other"})
    rows.append(rows[-2] | {"fact_id": "old", "status": "superseded", "subject": "zzzz-old-policy"})
    store.remember(spark.createDataFrame(rows))
    queries = spark.createDataFrame([("q", "who gets paged when service health breaks")], "query_id string, text string")
    got = store.recall(queries, "u", "w", k=10, now_ms=0).orderBy("rank").collect()
    assert got[0]["fact_id"] == "gold" and not {"elsewhere", "old"} & {r["fact_id"] for r in got}
    boot = spark.createDataFrame([("q", "", True)], "query_id string, text string, broad boolean")
    filled = store.recall(boot, "u", "w", k=50, now_ms=0).collect()
    assert {r["fact_id"] for r in filled} == {r["fact_id"] for r in rows} - {"elsewhere", "old"}
