"""The store's tools end to end."""

from __future__ import annotations

import pytest

from chronofact.api import FactStore

COLUMNS = "fact_id string, subject string, predicate string, object_str string, asserted_by string, trust_tier string, user_id string, workspace_id string, t_recorded bigint, status string, event_ids array<string>, fact_kind string"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = FactStore(spark, str(tmp_path_factory.mktemp("store")))
    s.capture(spark.createDataFrame([("e1", "s1", "tool_result", "{}", 5), ("e2", "s1", "tool_result", "{}", 50)], "episode_id string, session_id string, event_type string, payload string, created_at bigint"))
    refused = s.learn(spark.createDataFrame([
        ("f1", "repo", "test_command", "pnpm run test", "deterministic_parser", "high", "u", "w", 1, "active", ["e1"], "semantic"),
        ("f2", "repo", "test_command", "pnpm run test", "deterministic_parser", "high", "u", "w", 2, "active", ["e1", "e9"], "semantic"),
        ("f3", "repo", "deploy", "ship it with canary rollout", "user", "high", "u", "w", 3, "active", ["e2"], "semantic"),
        ("f4", "repo", "key", "password=abcdefghijkl12", "user", "high", "u", "w", 4, "active", None, "semantic"),
        ("f5", "repo", "loop", "finish the canary docs", "user", "high", "u", "w", 5, "active", None, "open_loop"),
    ], COLUMNS))
    assert [r["fact_id"] for r in refused.collect()] == ["f4"]
    return s


def test_same_statements_merge(store):
    got = {r["fact_id"]: (r["status"], r["evidence_count"]) for r in store.current().collect()}
    assert got == {"f1": ("active", 2), "f2": ("superseded", 1), "f3": ("active", 1), "f5": ("active", 1)}


def test_recall_and_capsule(store, spark):
    q = spark.createDataFrame([(1, "canary rollout"), (2, "nothing like it")], "query_id int, text string")
    out = store.recall(q, "u", "w").collect()
    found = {i: [r["fact_id"] for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == i] for i in (1, 2)}
    assert found[1][:2] == ["f3", "f5"]  # f1 fills the list by meaning alone, as all do where no word is met
    assert set(found[1]) == set(found[2]) == {"f1", "f3", "f5"}
    assert store.recall(q, "other").count() == 0
    assert [r["fact_id"] for r in store.recall(q, "u", "w", valid=spark.createDataFrame([("f5",)], "fact_id string")).collect()] == ["f5", "f5"]
    text = store.inject_context("u", workspace="w").first()["markdown"]
    assert "Unfinished: finish the canary docs" in text and "Run tests with: pnpm run test." in text


def test_why(store, spark):
    ids = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "fact_id string")
    got = {r["fact_id"]: (r["evidence"], r["missing"], r["complete"]) for r in store.why(ids).collect()}
    assert got == {"f1": (["e1"], [], True), "f2": (["e1"], ["e9"], False), "f3": (["e2"], [], True)}
    early = {r["fact_id"]: r["complete"] for r in store.why(ids, as_of_ms=10).collect()}
    assert early == {"f1": True, "f2": False, "f3": False}
    assert {r["fact_id"] for r in store.why(ids, as_of_ms=1).collect()} == {"f1"}


def test_promote_and_forget(store, spark):
    got = {r["fact_id"]: r["decision"] for r in store.promote().collect()}
    assert got["f1"] == "promote:config_evidence" and got["f2"] == "reject:bad_lifecycle" and got["f3"] == "candidate:insufficient_evidence"
    store.promote(dry_run=False, at_ms=60)
    assert store.current().filter("fact_id = 'f1' AND promotion_state = 'workspace_active'").count() == 1
    store.forget(spark.createDataFrame([("f3",)], "fact_id string"), 99)
    row = store.current().filter("fact_id = 'f3'").first()
    assert (row["status"], row["t_expired"], row["invalidated_by"]) == ("expired", 99, "f3")
    then = {at: store.why(spark.createDataFrame([("f3",)], "fact_id string"), as_of_ms=at).first()["status"] for at in (50, 99)}
    assert then == {50: "active", 99: "expired"}  # an earlier view knows nothing of what was forgotten later
    assert store.resolve_conflict().count() == 0
    assert store.checkpoint_session("none").count() == 0
