"""The invalidation cascade, writes that are seen at once, provenance."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chronofact.api import FactStore
from chronofact.operators import lifecycle as L
from chronofact.operators import provenance as P
from chronofact.sources.log import SnapshotLog, WriteConflict

COLUMNS = "user_id string, subject string, predicate string, seq bigint, fact_id string, object_str string, trust_tier string, asserted_by string, promotion_state string, tags_text string, workspace_id string, session_id string, branch string, removed boolean, incoming boolean, status string, evidence_count bigint, contradiction_count bigint"
KEYS = ["user_id", "subject", "predicate"]


def drawn(n: int, seed: int, gone: float) -> list[dict]:
    """Random facts; a third of them of one key."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if r.random() < 1 / 3 else r.randrange(1, 9)
        out.append({
            "user_id": "u", "subject": f"k{key}", "predicate": "p", "seq": r.randrange(n // 2), "fact_id": f"f{i:04d}", "object_str": r.choice(["a", "b", "c", "", None]), "trust_tier": r.choice(["high", "low"]),
            "asserted_by": r.choice(["user", "agent", "tool", "deterministic_parser"]), "promotion_state": r.choice(["session_only", "session_only", "workspace_active", "user_static_active", "user_dynamic_candidate"]), "tags_text": r.choice(["", "safety"]),
            "workspace_id": r.choice([None, "w1", "w2"]), "session_id": r.choice([None, None, "s1", "s2"]), "branch": r.choice([None, None, "main", "feat"]), "removed": key % 3 == 1 and r.random() < gone,
            "incoming": r.random() < 0.9, "status": r.choice(["active", "active", "candidate"]), "evidence_count": r.randrange(1, 4), "contradiction_count": 0,
        })
    return out


def rank(f: dict, at: str | None) -> int:
    if f["tags_text"] == "safety":
        return 0
    if f["asserted_by"] == "user" and at is not None and f["session_id"] == at:
        return 1
    if f["asserted_by"] == "deterministic_parser":
        return 2 if f["trust_tier"] == "high" else 8
    known = {"workspace_active": 3, "user_static_active": 4, "user_dynamic_candidate": 5}
    return known.get(f["promotion_state"], 7 if f["asserted_by"] == "agent" else 6)


def wide(f: dict) -> bool:
    return f["promotion_state"].startswith("user_") or (f["workspace_id"] is None and f["session_id"] is None)


def place(f: dict) -> tuple:
    return ("user",) if wide(f) else ("s", f["workspace_id"], f["session_id"]) if f["session_id"] else ("w", f["workspace_id"])


def stands(i: dict, e: dict) -> str:
    """The rule in plain words, from the facts themselves."""
    if i["workspace_id"] and not i["session_id"] and not wide(i) and wide(e):
        return "coexists"
    if i["branch"] and e["branch"] and i["branch"] != e["branch"]:
        return "coexists"
    if (i["object_str"] or "") == (e["object_str"] or "") and (i["object_str"] is None) == (e["object_str"] is None):
        return "same" if place(i) == place(e) else "coexists"
    if e["removed"]:
        return "invalidates"
    if place(i) != place(e):
        return "unrelated"
    if rank(i, i["session_id"]) > rank(e, i["session_id"]):
        return "coexists"
    return "refines" if i["trust_tier"] == "high" and i["asserted_by"] != "agent" else "conflicts"


def by_hand(rows: list[dict]) -> tuple[dict, set]:
    """Every new fact against all that stand, one after the other."""
    state, met, there = {r["fact_id"]: dict(r, by=None) for r in rows}, set(), []
    for i in sorted(rows, key=lambda r: (r["incoming"], r["seq"], r["fact_id"])):
        own = state[i["fact_id"]]
        count = own["contradiction_count"]
        for e in (there if i["incoming"] else []):
            old = state[e["fact_id"]]
            if e["subject"] != i["subject"] or old["status"] in ("superseded", "expired"):
                continue
            verdict = stands(i, e)
            if verdict == "unrelated" or (verdict == "coexists" and not (i["workspace_id"] and e["promotion_state"].startswith("user_"))):
                continue
            met.add((i["fact_id"], e["fact_id"], verdict))
            if verdict == "same":
                old["evidence_count"] += own["evidence_count"]
                own["status"], own["by"] = "superseded", e["fact_id"]
            elif verdict == "refines":
                old["status"], old["by"] = "superseded", i["fact_id"]
            elif verdict == "invalidates":
                old["status"], old["by"] = "expired", i["fact_id"]
            elif verdict == "conflicts":
                old["status"] = own["status"] = "disputed"
                old["contradiction_count"] += 1
                own["contradiction_count"] = count + 1
        there.append(i)
    return {f: (s["status"], s["evidence_count"], s["contradiction_count"], s["by"]) for f, s in state.items()}, met


def featured(spark, rows: list[dict]):
    df = spark.createDataFrame([[r[c.split()[0]] for c in COLUMNS.split(", ")] for r in rows], COLUMNS).repartition(3)
    # A missing value isn't the empty one.
    df = df.withColumn("object_str", F.coalesce("object_str", F.lit("(none)")))
    return df.select(*KEYS, "seq", "fact_id", "incoming", "status", "evidence_count", "contradiction_count", *[v.alias(k) for k, v in L.features(F.col, F.col("removed")).items()])


@pytest.mark.parametrize("seed,gone", [(1, 0.0), (2, 0.3)])
def test_cascade_by_hand(spark, seed, gone):
    """Levels, branches, sessions, targets that are gone, profiles, facts that were there before; a third of the rows in one key."""
    rows = drawn(300, seed, gone)
    want, met = by_hand(rows)
    got = L.cascade(featured(spark, rows), KEYS).collect()
    assert {r["fact_id"]: (r["status"], r["evidence_count"], r["contradiction_count"], r["closed_by"]) for r in got if r["existing"] is None} == want
    pairs = [(r["fact_id"], r["existing"], r["relation"]) for r in got if r["existing"] is not None]
    assert len(pairs) == len(set(pairs)) and set(pairs) == met
    kinds = {v for _, _, v in met}
    assert {"same", "refines", "conflicts", "coexists"} <= kinds and ("invalidates" in kinds) == (gone > 0)


def test_cascade_of_nothing(spark):
    assert L.cascade(featured(spark, drawn(3, 1, 0)).limit(0), KEYS).count() == 0


def test_columns_and_values_agree(spark):
    """The pairwise queries and the fold read one list of rules."""
    rows = drawn(60, 3, 0.5)
    df = spark.createDataFrame([[r[c.split()[0]] for c in COLUMNS.split(", ")] for r in rows], COLUMNS).withColumn("object_str", F.coalesce("object_str", F.lit("(none)")))
    i, e = (df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]) for p in "ie")
    of = lambda p: lambda c: F.col(f"{p}_{c}")
    got = i.join(e, F.col("i_subject") == F.col("e_subject")).select("i_fact_id", "e_fact_id", L.relation(of("i"), of("e"), F.col("e_removed"))).collect()
    facts = {r["fact_id"]: r for r in rows}
    assert len(got) > 300 and all(v == stands(facts[a], facts[b]) for a, b, v in got)


FACTS = "fact_id string, subject string, predicate string, object_str string, asserted_by string, trust_tier string, user_id string, workspace_id string, t_recorded bigint, status string, event_ids array<string>, branch string, path_globs array<string>, raw_quote string"


def fact(i: str, text: str, at: int, *, by: str = "user", trust: str = "high", branch: str | None = None, paths: list[str] | None = None, events: list[str] | None = None, quote: str | None = None) -> tuple:
    return (i, "repo", "build", text, by, trust, "u", "w", at, "active", events, branch, paths, quote)


def test_learn_writes_versions_and_edges(spark, tmp_path):
    store = FactStore(spark, str(tmp_path))
    first = spark.createDataFrame([fact("a", "make", 1, paths=["Makefile"]), fact("b", "make", 2), fact("f", "bazel", 3, branch="feat"), fact("c", "ninja", 4, branch="main", by="agent", trust="low")], FACTS)
    store.learn(first)
    state = lambda: {r["fact_id"]: (r["status"], r["evidence_count"], r["contradiction_count"], r["invalidated_by"]) for r in store.current().collect()}
    # f refines a wherever it holds; c is of lower rank than none of its branch, for f is on another one.
    assert state() == {"a": ("superseded", 2, 0, "f"), "b": ("superseded", 1, 0, "a"), "f": ("active", 1, 0, None), "c": ("active", 1, 0, None)}
    edges = lambda: {(r["from_id"], r["edge_kind"], r["to_id"]) for r in store.edges().collect()}
    assert edges() == {("a", "SUPPORTED_BY", "b"), ("b", "SUPERSEDED_BY", "a"), ("f", "SUPERSEDES", "a"), ("a", "SUPERSEDED_BY", "f")}
    before = (store.log().count(), store.tables.latest().number)
    store.learn(first)  # given again
    assert store.log().count() == before[0] and len(edges()) == 4
    store.learn(spark.createDataFrame([fact("g", "gradle", 5, branch="main", by="agent", trust="low", paths=["gone"])], FACTS))
    store.learn(spark.createDataFrame([fact("h", "cmake", 6, branch="main", by="agent", trust="low")], FACTS), files=spark.createDataFrame([("there",)], "path_glob string"))
    assert state() | {"a": 0, "b": 0, "f": 0} == {"a": 0, "b": 0, "f": 0, "c": ("disputed", 1, 2, None), "g": ("expired", 1, 1, "h"), "h": ("disputed", 1, 1, None)}
    assert {d["fact_id"]: d["decision"] for d in store.promote().collect()}["f"] == "candidate:insufficient_evidence"
    assert state()["g"][0] == "expired" and store.log(store.tables.at(before[1])).count() == before[0]


def test_writes_are_seen_at_once(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path), {"a": "x int", "b": "y string"})
    rows = lambda n: spark.range(n).select(F.col("id").cast("int").alias("x"))
    log.append(a=rows(2))
    broken = rows(3).select(F.raise_error(F.lit("lost")).cast("string").alias("y"))
    with pytest.raises(Exception, match="lost"):
        log.transact(lambda at: {"a": rows(5), "b": broken})
    assert log.latest().number == 1 and log.latest().read("a").count() == 2 and log.latest().read("b").count() == 0
    seen = []

    def build(at):
        seen.append(at.read("a").count())
        if len(seen) == 1:
            log.append(a=rows(4))  # another writer is faster
        return {"a": rows(seen[-1])}

    assert log.transact(build).number == 3 and seen == [2, 6] and log.latest().read("a").count() == 12
    with pytest.raises(WriteConflict):
        log.transact(lambda at: (log.append(a=rows(1)), {"a": rows(1)})[1], tries=2)
    assert log.compact("a").folders["a"] != log.at(1).folders["a"] and log.latest().read("a").count() == 14 and log.at(1).read("a").count() == 2


def test_provenance_over_a_cycle(spark, tmp_path):
    edges = spark.createDataFrame([("a", "SUPERSEDES", "b", 1), ("b", "SUPPORTED_BY", "c", 2), ("c", "SUPERSEDES", "a", 3), ("c", "SUPERSEDES", "d", 9), ("a", "CONFLICTS_WITH", "e", 1), ("a", "SUPERSEDES", "b", 4)], "from_id string, edge_kind string, to_id string, created_at bigint")
    roots = spark.createDataFrame([("a",), ("a",), ("e",)], "fact_id string")
    hops = lambda n: {tuple(r) for r in P.chain(roots, edges, n).collect()}
    assert hops(9) == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("e", "e", 0)} and hops(1) == {("a", "a", 0), ("a", "b", 1), ("e", "e", 0)}
    assert P.chain(roots.limit(0), edges, 2).count() == 0

    store = FactStore(spark, str(tmp_path))
    store.capture(spark.createDataFrame([("e1", "s", "tool_result", "{}", 1), ("e2", "s", "tool_result", "{}", 50)], "episode_id string, session_id string, event_type string, payload string, created_at bigint"))
    store.learn(spark.createDataFrame([fact("old", "make", 1, events=["e1", "e7"]), fact("new", "ninja", 2, events=["e2", "e2"])], FACTS))
    store.promote(dry_run=False, at_ms=60)
    # Rows of before secrets were refused.
    store.tables.append(facts=store.current().filter("fact_id = 'new'").withColumn("raw_quote", F.lit("see https://joe:hunter22@host/x")).withColumn("version", F.col("version") + 1))
    ids = spark.createDataFrame([("new",), ("nobody",)], "fact_id string")
    hops, told = store.provenance(ids)
    assert {tuple(r) for r in hops.collect()} == {("new", "new", 0), ("new", "old", 1)}
    got = {(r["fact_id"], r["part"], r["line"]) for r in told.collect()}
    assert {("old", "evidence", "e1 tool_result"), ("old", "missing", "e7"), ("new", "evidence", "e2 tool_result"), ("new", "edge", "SUPERSEDES to old"), ("old", "edge", "SUPERSEDES from new")} <= got
    assert ("new", "promotion", "session_only to workspace_candidate candidate:insufficient_evidence") in got
    assert ("new", "quote", "see [REDACTED:url_password]host/x") in got and not any("hunter22" in line for *_, line in got)
    whole = {r["fact_id"]: (r["n_evidence"], r["n_missing"], r["complete"]) for r in P.summary(told).collect()}
    assert whole == {"old": (1, 1, False), "new": (1, 0, True)}
    _, early = store.provenance(ids, as_of_ms=2)
    parts = {(r["fact_id"], r["part"]) for r in early.collect()}
    assert ("new", "later") in parts and ("new", "promotion") not in parts and ("new", "edge") in parts
    assert store.why(spark.createDataFrame([("new",)], "fact_id string")).first()["raw_quote"] == "see [REDACTED:url_password]host/x"


def test_capsules_for_prompts_and_tools(spark, tmp_path):
    """Only requests that pass the gate are answered, from what they ask; a conflict is noted beside its winner; nothing is told twice."""
    store = FactStore(spark, str(tmp_path))
    rows = [
        ("w1", "deploy", "strategy", 'canary "slow" rollout', "user", "high", "u", "w", 1, "active", None, None, None, None), ("w2", "deploy", "strategy", "big bang rollout", "agent", "high", "u", "w", 2, "active", None, None, None, None),
        ("p1", "repo", "claims", "canary rollout is slow", "deterministic_parser", "low", "u", "w", 3, "active", None, None, None, None),
    ]
    store.remember(spark.createDataFrame(rows, FACTS))
    ask = spark.createDataFrame([("q1", "canary rollout", 0.9, None), ("q2", "canary rollout", 0.1, None)], "request_id string, text string, drift double, tool string")
    got = {r["request_id"]: r["markdown"] for r in store.inject_requests(ask, "UserPromptSubmit", "u", "w", "s", now_ms=1000).collect()}
    assert set(got) == {"q1"}
    assert 'Conflicting deploy strategy: "canary \\"slow\\" rollout" wins over "big bang rollout" (older session memory > agent inference). [conflict:' in got["q1"] and "**Conflict notes:**" in got["q1"]
    assert 'the repo claims: "canary rollout is slow"' in got["q1"] and got["q1"].count("big bang") == 1
    assert store.inject_requests(ask, "UserPromptSubmit", "u", "w", "s", now_ms=2000).filter("markdown LIKE '%canary%'").count() == 0
    tool = spark.createDataFrame([("t1", "canary rollout", "bash", "npm run deploy"), ("t2", "canary rollout", "bash", "echo"), ("t3", "canary rollout", "read", "x")], "request_id string, text string, tool string, args string")
    got = {r["request_id"]: r["markdown"] for r in store.inject_requests(tool, "PreToolUse", "u", "w", "other", now_ms=3000).collect()}
    assert set(got) == {"t1"} and "the repo claims" not in got["t1"] and "slow" in got["t1"]
