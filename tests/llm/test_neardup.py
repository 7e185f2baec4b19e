"""The pipeline's near-dedup stage against all pairs."""

from __future__ import annotations

import random

import pytest
from conftest import rows

from chronofact.llm import neardup


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept(docs):
    """Least (id, text) of each component of all pairs with a likeness of 0.8 or more."""
    nodes = {}
    for i, t in docs:
        s, at = shingles(t), (-(2**63) if i is None else i, t or "")
        nodes[s] = min(nodes.get(s, at), at)
    sets, root = list(nodes), {s: s for s in nodes}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(sets):
        for b in sets[:i]:
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for s in sets:
        r = find(s)
        least[r] = min(least.get(r, nodes[s]), nodes[s])
    return sorted(i for i, _ in least.values())


def edited(base, n, rng):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


def corpus():
    """Pairs on both sides of 0.8, a crowd of near copies, and a crowd that only links through its members; a line in all."""
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(5000)}"
    line = " the same line of ten words stands in all documents"
    texts = []
    for k in range(60):
        base = [word() for _ in range(200)]
        texts += [" ".join(base) + line, edited(base, k % 9, rng) + line]
    for edits in (1, 3, 4):
        base = [word() for _ in range(150)]
        texts += [edited(base, edits, rng) + line for _ in range(120)]
    return list(enumerate(texts))


@pytest.mark.parametrize("rounds", [0, neardup.ROUNDS])
def test_all_pairs_of_the_likeness_are_linked(spark, monkeypatch, rounds):
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    found = corpus()
    docs = spark.createDataFrame(found, "doc_id bigint, text string").repartition(3)
    assert sorted(r["doc_id"] for r in neardup.drop_near_duplicates(docs).collect()) == kept(found)


def test_stage_drops_edited_copies(spark, sf_dir):
    """Copies with a likeness just over 0.8, whose fingerprints are several bits apart."""
    import corpus_pipeline

    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    found = [(0, " ".join(base))] + [(i, edited(base, 6, rng)) for i in range(1, 4)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in found], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf_dir)
    assert [r["doc_id"] for r in got.collect()] == kept(found) == [0]


def test_edge_cases(docs, empty):
    got = neardup.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(-(2**63) if r["doc_id"] is None else r["doc_id"] for r in got.collect()) == kept([(r[0], r[1]) for r in rows()])
    assert neardup.drop_near_duplicates(empty).count() == 0


def test_stage_links_fingerprints(spark, sf_dir):
    """Texts that mostly repeat one passage: fingerprints within 2 bits, a Jaccard likeness far below 0.8."""
    import corpus_pipeline
    from chronofact.llm import simhash

    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(13))
    found = [(i, " ".join([passage] * 200 + [f"w{rng.randrange(10**6)}" for _ in range(20)])) for i in range(40)] + [(40, "another text of some words")]
    first = simhash.fingerprint(found[0][1])
    assert all((simhash.fingerprint(t) ^ first).bit_count() <= 2 for _, t in found[:40])
    assert len(kept(found)) == 41
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in found], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 40]


def test_crowd_of_unlike_copies_makes_few_pairs(spark, monkeypatch):
    """Copies edited too much to have the likeness meet under common shingles; only the pairs that may have it are compared."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    found = list(enumerate([" ".join(base)] + [edited(base, 1 + k % 8, rng) for k in range(300)]))
    pairs, verified = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda p, *rest: (pairs.append(p.count()), verified(p, *rest))[1])
    docs = spark.createDataFrame(found, "doc_id bigint, text string").repartition(3)
    assert sorted(r["doc_id"] for r in neardup.drop_near_duplicates(docs).collect()) == kept(found)
    assert sum(pairs) < 5 * len(found)


def test_driver_plans_little(spark, monkeypatch):
    """Rounds over a crowd read no texts again, and the plans that the driver makes and keeps are few."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    found = list(enumerate([" ".join(base)] + [edited(base, 1 + k % 8, rng) for k in range(150)]))
    read, with_set = [], neardup.with_set
    monkeypatch.setattr(neardup, "with_set", lambda *a: (read.append(1), with_set(*a))[1])
    docs = spark.createDataFrame(found, "doc_id bigint, text string").repartition(3)
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = max([e.executionId() for e in _java(store.executionsList())], default=-1)
    got = neardup.drop_near_duplicates(docs, radius=2)
    assert len(read) <= 3  # the sample's, the small groups', the crowd's
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    own = [e for e in _java(store.executionsList()) if e.executionId() > before]
    assert len(own) <= 160
    assert not any("TakeOrderedAndProject" in e.physicalPlanDescription() for e in own)  # each task would send the driver FREQUENT rows
    assert 0 < got.count() <= len(kept(found))


def _java(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_frequent_is_bounded_among_equal_counts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FREQUENT", 400)
    both = " ".join(f"b{i}" for i in range(2004))
    found = [(1, 1, both + " " + " ".join(f"c{i}" for i in range(100))), (2, 2, both), (3, 3, " ".join(f"c{i}" for i in range(100))), (4, 4, " ".join(f"c{i}" for i in range(100)))]
    hashes, counts = neardup.frequent(spark.createDataFrame(found, "__id bigint, __th bigint, __t string"), 4, 5)
    assert (counts == 3).sum() == 96 and set(counts.tolist()) == {2, 3}
    assert 200 < (counts == 2).sum() < 420
    assert (hashes[1:] > hashes[:-1]).all()


def test_join_by_key_without_hot_keys(spark):
    from pyspark.sql import functions as F

    from chronofact.storage import join_by_key, materialise

    left = spark.createDataFrame([(k % 7, k) for k in range(50)] + [(None, -1)], "k bigint, v bigint")
    right = materialise(left.filter("k < 5").groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    told = join_by_key(left, right, ["k"], "n", 50, F.col("v"), 8)
    assert "__jhot" not in told._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, told.collect())) == sorted(map(str, join_by_key(left, right, ["k"], "n", 50, F.col("v")).collect()))


def test_components_go_on_from_earlier_ones(spark):
    from chronofact.llm.simhash import components

    edges = lambda found: spark.createDataFrame(found, "__a bigint, __b bigint")
    one = [(i, i + 1) for i in range(0, 40, 2)]
    more = one + [(i, i + 2) for i in range(1, 19, 2)] + [(38, 39), (90, 91)]
    assert {tuple(r) for r in components(edges(more), components(edges(one))).collect()} == {tuple(r) for r in components(edges(more)).collect()}
