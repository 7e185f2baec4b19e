"""Why a fact is in memory: what it superseded or rests on, and the lines of evidence, promotions and edges of each fact on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.functions.secrets import redact
from chronofact.storage import materialise

#: Edges that lead back to where a fact comes from.
BACK = ("SUPERSEDES", "SUPPORTED_BY")


def chain(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(root, fact_id, hop): what is reached from each root (column fact_id) along BACK edges in at most `depth` steps, each fact once, at its least hop. Cycles end by themselves.

    roots may repeat. One join a step; a step looks only at what the last one found.
    """
    links = edges.filter(F.col("edge_kind").isin(*BACK)).select(F.col("from_id").alias("fact_id"), F.col("to_id").alias("__next")).distinct()
    front = materialise(roots.select(F.col("fact_id").alias("root"), "fact_id").distinct().withColumn("hop", F.lit(0)))
    seen = front
    for hop in range(1, depth + 1):
        found = front.join(links, "fact_id").select("root", F.col("__next").alias("fact_id")).distinct()
        front = materialise(found.join(seen.select("root", "fact_id"), ["root", "fact_id"], "left_anti").withColumn("hop", F.lit(hop)))
        if not front.take(1):
            break
        seen = seen.unionByName(front)
    return seen


def lines(facts: DataFrame, cited: DataFrame, episodes: DataFrame, promotions: DataFrame, edges: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(fact_id, part, line), a row a line, all text redacted; of what was written by `as_of`, if given.

    facts: fact_id, subject, predicate, asserted_by, status, t_recorded, raw_quote; cited: fact_id, episode_id; episodes: episode_id, event_type, created_at; promotions: fact_id, from_state, to_state,
    decision, created_at; edges: from_id, edge_kind, to_id, created_at. An edge is told to both its ends. No list is gathered, so a fact that millions support is no
    harder than others. Evidence that is cited but later than `as_of` is told as `later`.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    past = lambda c: F.lit(True) if as_of is None else F.coalesce(F.col(c) <= as_of, F.lit(True))
    known = facts.filter(past("t_recorded"))
    ids = known.select("fact_id").distinct()
    said = F.concat_ws(" ", redact(text("subject")), redact(text("predicate")), F.lit("asserted by"), text("asserted_by"), F.lit("status"), text("status"), F.lit("recorded"), text("t_recorded"))
    out = known.select("fact_id", F.explode(F.array(F.struct(F.lit("fact").alias("part"), said.alias("line")), F.struct(F.lit("quote").alias("part"), redact(F.col("raw_quote")).alias("line")))).alias("__x")).select("fact_id", "__x.*").filter("line IS NOT NULL")
    event = episodes.select("episode_id", F.col("event_type").alias("__type"), F.col("created_at").alias("__at"), F.lit(True).alias("__there"))
    there = cited.join(ids, "fact_id", "left_semi").distinct().join(event, "episode_id", "left")
    part = F.when(F.col("__there").isNull(), "missing").when(past("__at"), "evidence").otherwise("later")
    parts = [there.select("fact_id", part.alias("part"), F.concat_ws(" ", redact(text("episode_id")), "__type").alias("line"))]
    told = promotions.filter(past("created_at")).join(ids, "fact_id", "left_semi")
    parts.append(told.select("fact_id", F.lit("promotion").alias("part"), F.concat_ws(" ", text("from_state"), F.lit("to"), text("to_state"), redact(text("decision"))).alias("line")))
    ends = edges.filter(past("created_at"))
    for own, other, way in (("from_id", "to_id", "to"), ("to_id", "from_id", "from")):
        parts.append(ends.select(F.col(own).alias("fact_id"), F.lit("edge").alias("part"), F.concat_ws(" ", "edge_kind", F.lit(way), redact(text(other))).alias("line")).join(ids, "fact_id", "left_semi"))
    for more in parts:
        out = out.unionByName(more)
    return out


def summary(told: DataFrame) -> DataFrame:
    """(fact_id, n_evidence, n_missing, n_promotions, n_edges, complete) of lines: whole if all that is cited is there."""
    n = lambda part: F.count_if(F.col("part") == part)
    counted = told.groupBy("fact_id").agg(n("evidence").alias("n_evidence"), n("missing").alias("n_missing"), n("promotion").alias("n_promotions"), n("edge").alias("n_edges"), n("later").alias("__later"))
    return counted.withColumn("complete", F.col("n_missing") + F.col("__later") == 0).drop("__later")
