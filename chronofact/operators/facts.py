"""Scans, scope and lifecycle filters over facts; set operations and aggregates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.functions import text as T



def scope_clause(user: str | None = None, workspace: str | None = None, session: str | None = None) -> Column:
    """Equality for the given keys only; a missing key constrains nothing."""
    out = F.lit(True)
    for name, value in (("user_id", user), ("workspace_id", workspace), ("session_id", session)):
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def in_scope(user: Column, workspace: Column, session: Column) -> Column:
    """Visibility: the user's own; a session's facts in that session, a workspace's in that workspace, others everywhere."""
    same_workspace = F.col("workspace_id").isNull() | F.coalesce(F.col("workspace_id") == workspace, F.lit(False))
    seen = F.when(F.col("session_id").isNotNull(), F.coalesce(F.col("session_id") == session, F.lit(False)) & same_workspace).otherwise(same_workspace)
    return (F.col("user_id") == user) & seen


def latest(versions: DataFrame, key: str, version: str) -> DataFrame:
    """The current rows of an append-only version log: one aggregation that combines before its shuffle."""
    rest = [c for c in versions.columns if c != key]
    out = versions.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("__row"))
    return out.select(key, "__row.*").select(*versions.columns)


def top_per(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank. Spark prunes each partition to n rows a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)


def memory_stats(facts: DataFrame) -> DataFrame:
    """Counts by status, trust and scope level in one pass."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    return facts.agg(
        F.count(F.lit(1)).alias("total"), *[is_("status", s).alias(f"status_{s}") for s in ("active", "candidate", "expired", "superseded", "disputed")],
        is_("trust_tier", "high").alias("trust_high"), is_("trust_tier", "low").alias("trust_low"),
        F.count_if(F.col("session_id").isNotNull()).alias("scope_session"), F.count_if(F.col("session_id").isNull() & F.col("workspace_id").isNotNull()).alias("scope_workspace"),
        F.count_if(F.col("session_id").isNull() & F.col("workspace_id").isNull()).alias("scope_user"), is_("fact_kind", "open_loop").alias("open_loops"), is_("sensitivity", "secret").alias("secrets"),
    )


def conflict_groups(facts: DataFrame) -> DataFrame:
    """(subject, predicate) with more than one value. Values are compared by hash, so no group gathers its texts."""
    return (
        facts.groupBy("user_id", "subject", "predicate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.sha2("object_str", 256)).alias("n_values"))
        .filter("n_values > 1").withColumn("conflict_id", T.conflict_id(F.col("subject"), F.col("predicate")))
    )


def already_known(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming facts that no unexpired stored fact of the same scope states."""
    on = [F.col("i.subject") == F.col("s.subject"), F.col("i.predicate") == F.col("s.predicate"), F.col("i.object_str") == F.col("s.object_str"), F.col("i.user_id") == F.col("s.user_id"), F.col("i.workspace_id").eqNullSafe(F.col("s.workspace_id"))]
    return incoming.alias("i").join(stored.filter("status <> 'expired'").alias("s"), on, "left_anti")


def stale_evidence(active: DataFrame, evidence: DataFrame) -> DataFrame:
    """Managed active facts that the current evidence no longer states."""
    keys = ["subject", "predicate", "object_str"]
    return active.join(evidence.select(*keys).distinct(), keys, "left_anti")
