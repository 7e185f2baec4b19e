"""Lifecycle rules as ordered cascades, and their effects as new version rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronofact.functions import scoring as S
from chronofact.shipping import ship
from chronofact.storage import join_by_key, materialise


def secret_bearing(c: Callable[[str], Column], scanner: Column) -> Column:
    return c("sensitivity").isin("secret", "credential") | scanner


def session_to_workspace(c: Callable[[str], Column], secret: Column, unresolved: Column, repo_scoped: Column, successes: Column) -> Column:
    """`decision:reason`; the first rule that holds decides."""
    return (
        F.when(secret, "reject:secret").when(c("fact_kind") == "task_state", "reject:session_local")
        .when(c("status").isin("disputed", "expired", "rejected", "superseded"), "reject:bad_lifecycle").when(unresolved, "candidate:needs_resolution")
        .when((c("asserted_by") == "user") & repo_scoped, "promote:user_explicit")
        .when((c("asserted_by") == "deterministic_parser") & (c("trust_tier") == "high") & c("workspace_id").isNotNull(), "promote:config_evidence")
        .when((c("fact_kind") == "procedural") & (successes >= 2), "promote:verified_procedure")
        .when(c("fact_kind").isin("failure", "constraint") & (c("evidence_count") >= 2), "promote:repeated").otherwise("candidate:insufficient_evidence")
    )


def workspace_to_user(c: Callable[[str], Column], secret: Column, global_: Column) -> Column:
    return (
        F.when(secret, "reject:secret").when(~c("fact_kind").isin("preference", "procedural", "constraint"), "reject:not_profile_material")
        .when(c("status").isin("disputed", "expired", "rejected", "superseded"), "reject:bad_lifecycle")
        .when((c("asserted_by") == "user") & global_, F.when(c("temporal_kind") == "static", "promote:user_static").otherwise("promote:user_dynamic"))
        .when((c("asserted_by") == "deterministic_parser") | (c("trust_tier") == "low"), "reject:repo_convention").otherwise("candidate:explicit_only")
    )


#: Wording that ties a statement to the repository, or to everything.
REPO_WORDING = r"\b(repo|project|this codebase|this repo|workspace|here)\b"
GLOBAL_WORDING = r"\b(always|globally|every (?:project|repo)|in general|by default everywhere)\b"


def features(c: Callable[[str], Column], removed: Column) -> dict[str, Column]:
    """What the rules of relation ask of a fact, none of it null. `rank_own` is its precedence in its own session, `rank_far` in any other."""
    rank = lambda at: S.precedence_rank(c("asserted_by"), c("trust_tier"), c("promotion_state"), c("tags_text"), c("session_id"), at)
    wide = S.user_scoped(c("workspace_id"), c("session_id"), c("promotion_state"))
    yes = lambda x: F.coalesce(x, F.lit(False))
    return {
        "level": F.coalesce(S.scope_level(c("workspace_id"), c("session_id"), c("promotion_state")), F.lit("")), "object": F.coalesce(F.sha2(c("object_str"), 256), F.lit("")),
        "branch": F.coalesce(c("branch"), F.lit("")), "session": F.coalesce(c("session_id"), F.lit("")), "rank_own": rank(c("session_id")), "rank_far": rank(F.lit(None).cast("string")),
        "refiner": yes((c("trust_tier") == "high") & (c("asserted_by") != "agent")), "repo": yes(c("workspace_id").isNotNull() & c("session_id").isNull() & ~wide), "user_wide": yes(wide),
        "placed": c("workspace_id").isNotNull(), "profile": yes(c("promotion_state").startswith("user_")), "removed": yes(removed),
    }


FEATURES = "level string, object string, branch string, session string, rank_own int, rank_far int, refiner boolean, repo boolean, user_wide boolean, placed boolean, profile boolean, removed boolean"


def rules(i: Callable[[str], Any], e: Callable[[str], Any]) -> list[tuple[Any, str]]:
    """How an incoming fact of the same user, subject and predicate stands to an existing one: the first condition that holds decides, none means unrelated.

    `i` and `e` give features, as columns or as plain values: the pairwise queries and the fold evaluate the same rules.
    """
    level, same, at_home = i("level") == e("level"), i("object") == e("object"), (i("session") == e("session")) & (i("session") != "")
    outranked = (at_home & (i("rank_own") > e("rank_own"))) | ((i("session") != e("session")) & (i("rank_own") > e("rank_far"))) | ((i("session") == "") & (i("rank_own") > e("rank_far")))
    return [
        (i("repo") & e("user_wide"), "coexists"), ((i("branch") != "") & (e("branch") != "") & (i("branch") != e("branch")), "coexists"),
        (same & level, "same"), (same, "coexists"), (e("removed"), "invalidates"), (level & outranked, "coexists"), (level & i("refiner"), "refines"), (level, "conflicts"),
    ]


def decide(i: Callable[[str], Any], e: Callable[[str], Any]) -> str:
    """The rules over plain values."""
    return next((name for holds, name in rules(i, e) if holds), "unrelated")


def relation(i: Callable[[str], Column], e: Callable[[str], Column], removed: Column) -> Column:
    """The rules over columns: `i` and `e` give those of two facts; removed: the existing one's targets are gone."""
    of = lambda c, gone: features(c, gone).__getitem__
    out = F.when((i("subject") != e("subject")) | (i("predicate") != e("predicate")), "unrelated")
    for holds, name in rules(of(i, F.lit(False)), of(e, removed)):
        out = out.when(holds, name)
    return out.otherwise("unrelated")


def effects(verdicts: DataFrame, *keep: str) -> DataFrame:
    """verdicts: incoming, existing, relation, overrides. One row an edge: from_id, edge_kind, to_id, and the columns to keep."""
    edge = lambda a, kind, b: F.struct(F.col(a).alias("from_id"), F.lit(kind).alias("edge_kind"), F.col(b).alias("to_id"))
    r = F.col("relation")
    edges = (
        F.when(r == "same", F.array(edge("existing", "SUPPORTED_BY", "incoming"), edge("incoming", "SUPERSEDED_BY", "existing")))
        .when(r == "refines", F.array(edge("incoming", "SUPERSEDES", "existing"), edge("existing", "SUPERSEDED_BY", "incoming")))
        .when(r == "invalidates", F.array(edge("incoming", "INVALIDATES", "existing")))
        .when(r == "conflicts", F.array(edge("incoming", "CONFLICTS_WITH", "existing")))
        .when((r == "coexists") & F.col("overrides"), F.array(edge("incoming", "OVERRIDES", "existing")))
    )
    return verdicts.select(F.explode(edges).alias("e"), *keep).select("e.*", *keep)


def reconcile(i: Callable[[str], Column], c: Callable[[str], Column], base_seen: Column, base_head: Column, ancestor: Column) -> Column:
    """What becomes of a write against the current fact; never that the last writer wins. ancestor: the current fact's valid_from is one of the base head."""
    return (
        F.when(c("fact_id").isNull(), "apply").when(F.coalesce(base_seen == c("fact_id"), F.lit(False)), "apply").when(i("object_str") == c("object_str"), "apply")
        .when(F.coalesce(i("branch") != c("branch"), F.lit(False)), "partition")
        .when((i("trust_tier") == "high") & (c("trust_tier") == "low") & base_head.isNotNull() & c("valid_from").isNotNull() & ancestor, "invalidate").otherwise("disputed")
    )


OUTCOME = "fact_id string, existing string, relation string, status string, evidence_count bigint, contradiction_count bigint, closed_by string, closed_at bigint"


def cascade(arrivals: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's facts in order of arrival, every new one against all that are open: rows of OUTCOME.

    arrivals: keys, seq, fact_id, incoming, status, evidence_count, contradiction_count and the features; facts that aren't incoming were there before. Rows with `existing` tell of a meeting that had
    an effect (relation same, refines, invalidates, conflicts, or coexists where repository facts override a profile), the others of what became of a fact. Equal times go by id.

    One arrival's outcome changes what the next one meets, so facts that can meet pass one task, in order; it streams them and holds only those open, which differ in value, branch or level. Levels
    meet only where a target was removed or a profile is overridden: without the first a key is split by level, for the second its profile sees witnesses of the others.
    """
    spark = arrivals.sparkSession
    ship(spark)
    names = [f.name for f in StructType.fromDDL(FEATURES)]
    rows = materialise(arrivals.select(*keys, F.col("seq").cast("bigint").alias("seq"), "fact_id", "incoming", "status", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("evidence_count", "contradiction_count")], *names))
    flags = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.bool_or("removed").alias("__gone"), F.bool_or("profile").alias("__profile")).filter("__gone OR __profile"))
    marked = join_by_key(rows, flags, keys, "__n", rows.count(), F.col("fact_id"))
    part = F.when(F.coalesce("__gone", F.lit(False)), "").otherwise(F.col("level"))
    watches = F.coalesce("__profile", F.lit(False)) & F.col("incoming") & F.col("placed") & (part != "") & (F.col("level") != "user")
    place = lambda p, witness: F.struct(p.alias("part"), F.lit(witness).alias("witness"))
    marked = marked.withColumn("__to", F.explode(F.when(watches, F.array(place(part, False), place(F.lit("user"), True))).otherwise(F.array(place(part, False)))))
    group = [*keys, "part"]
    dealt = marked.select(*rows.columns, "__to.*").repartition(*group).sortWithinPartitions(*group, "incoming", "seq", "fact_id")
    columns = [f.name for f in StructType.fromDDL(OUTCOME)]

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_ = None, []
        state = lambda r: (r["fact_id"], None, None, r["status"], r["evidence_count"], r["contradiction_count"], r["closed_by"], r["closed_at"])
        for batch in parts:
            out = []
            for new in batch.to_dict("records"):
                own = tuple(new[k] for k in group)
                if own != key:
                    out += map(state, open_)
                    key, open_ = own, []
                new |= {"closed_by": None, "closed_at": None}
                if not new["incoming"]:
                    open_.append(new)
                    continue
                against, closed = new["contradiction_count"], []
                for old in open_:
                    verdict = decide(new.__getitem__, old.__getitem__)
                    if verdict == "unrelated" or (new["witness"] and verdict != "coexists") or (verdict == "coexists" and not (new["placed"] and old["profile"])):
                        continue
                    out.append((new["fact_id"], old["fact_id"], verdict, None, None, None, None, None))
                    if verdict == "same":
                        old["evidence_count"] += new["evidence_count"]
                        new |= {"status": "superseded", "closed_by": old["fact_id"], "closed_at": new["seq"]}
                    elif verdict in ("refines", "invalidates"):
                        old |= {"status": "superseded" if verdict == "refines" else "expired", "closed_by": new["fact_id"], "closed_at": new["seq"]}
                        closed.append(old)
                    elif verdict == "conflicts":
                        old["status"] = new["status"] = "disputed"
                        old["contradiction_count"] += 1
                        new["contradiction_count"] = against + 1
                if new["witness"]:
                    continue
                out += map(state, closed)
                if closed:
                    open_ = [r for r in open_ if r["status"] not in ("superseded", "expired")]
                if new["status"] in ("superseded", "expired"):
                    out.append(state(new))
                else:
                    open_.append(new)
            yield pd.DataFrame(out, columns=columns).astype({"closed_at": "Int64", "evidence_count": "Int64", "contradiction_count": "Int64"})
        yield pd.DataFrame([*map(state, open_)], columns=columns).astype({"closed_at": "Int64", "evidence_count": "Int64", "contradiction_count": "Int64"})

    return dealt.mapInPandas(fold, OUTCOME)


def fold_arrivals(arrivals: DataFrame, keys: list[str]) -> DataFrame:
    """The cascade over facts of one branch without removed targets: (fact_id, status, evidence_count).

    arrivals: keys, seq, fact_id, object_hash, trust_tier, asserted_by, level, prec, evidence_count.
    """
    no, empty = F.lit(False), F.lit("")
    given = {
        "object": F.col("object_hash").cast("string"), "branch": empty, "session": empty, "rank_own": F.col("prec"), "rank_far": F.col("prec"), "refiner": (F.col("trust_tier") == "high") & (F.col("asserted_by") != "agent"),
        "repo": no, "user_wide": no, "placed": no, "profile": no, "removed": no, "incoming": F.lit(True), "status": F.lit("active"), "contradiction_count": F.lit(0).cast("bigint"), "seq": F.col("seq").cast("bigint"),
    }
    return cascade(arrivals.withColumns(given), keys).filter("existing IS NULL").select("fact_id", "status", "evidence_count")
