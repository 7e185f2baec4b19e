"""Scores, weights and ranks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_MS = 30 * 86_400_000
RRF_K = 60
CONSENSUS = 0.5 / 60


def decay(age_ms: Column) -> Column:
    """0.7 plus 0.3 halving every 30 days, above 1 before it begins; null for an unknown age."""
    return F.lit(0.7) + F.lit(0.3) * F.pow(F.lit(0.5), age_ms.cast("double") / HALF_LIFE_MS)


def recency(t_ms: Column, now_ms: Column) -> Column:
    """decay() of a time's age; 1 if the time is unknown or to come."""
    return F.when(t_ms.isNull(), 1.0).otherwise(decay(F.greatest(now_ms - t_ms, F.lit(0))))


def confidence_factor(c: Column) -> Column:
    known = F.when(c.isNull() | F.isnan(c), 0.5).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    return F.lit(0.75) + F.lit(0.25) * known


def scope_weight(session: Column, workspace: Column, promotion: Column, at_session: Column) -> Column:
    return (
        F.when(session.isNotNull() & (session == at_session), 1.0).when(workspace.isNotNull(), 0.9)
        .when(promotion.startswith("user_static"), 0.55).when(promotion.startswith("user_dynamic"), 0.4).otherwise(0.5)
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 for lengths that differ or zero vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 1.0).otherwise(1 - dot(a, b) / norms)


def distance_to_score(d: Column) -> Column:
    return 1 / (1 + F.greatest(d, F.lit(0.0)))


def rrf(lexical_rank: Column, semantic_rank: Column) -> Column:
    one = lambda r: F.coalesce(1.0 / (RRF_K + r), F.lit(0.0))
    return one(lexical_rank) + one(semantic_rank) + F.when(lexical_rank.isNotNull() & semantic_rank.isNotNull(), CONSENSUS).otherwise(0.0)


def precedence_rank(asserted_by: Column, trust: Column, promotion: Column, tags: Column, session: Column, at_session: Column) -> Column:
    """Lower wins."""
    return (
        F.when(tags.rlike(r"(^| )(safety|permissions)( |$)"), 0).when((asserted_by == "user") & F.coalesce(session == at_session, F.lit(False)), 1)
        .when((asserted_by == "deterministic_parser") & (trust == "high"), 2).when((asserted_by == "deterministic_parser") & (trust == "low"), 8)
        .when(promotion == "workspace_active", 3).when(promotion.startswith("user_static"), 4).when(promotion.startswith("user_dynamic"), 5)
        .when(asserted_by == "agent", 7).otherwise(6)
    )


def user_scoped(workspace: Column, session: Column, promotion: Column) -> Column:
    return promotion.startswith("user_") | (workspace.isNull() & session.isNull())


def scope_level(workspace: Column, session: Column, promotion: Column) -> Column:
    return (
        F.when(user_scoped(workspace, session, promotion), "user").when(session.isNotNull(), F.concat(F.lit("sess:"), F.coalesce(workspace, F.lit("")), F.lit(":"), session))
        .otherwise(F.concat(F.lit("ws:"), workspace))
    )


def percentile_index(p: int, n: Column) -> Column:
    """The 0-based place of a percentile in n sorted values, without interpolation."""
    return F.least(n - 1, F.floor(F.lit(p) / 100.0 * n))
