"""Providers as parameters: language models, their answers turned into facts, and where vectors go.

A provider is any function from prompts to answers, called in Arrow batches where the rows lie; None is the default and answers nothing, so that every
step below yields no rows without one. What an answer claims is never trusted: it is parsed, held against the evidence that exists, and enters low and as a candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.functions.secrets import contains_secret

Provider = Callable[[list[str]], list[str]]
VectorSink = Callable[[DataFrame], None]
CLAIM = "struct<subject:string,predicate:string,object:string,evidence:array<string>>"


def answered(prompts: DataFrame, prompt_col: str, provider: Provider | None, out: str = "answer") -> DataFrame:
    """prompts with the provider's answers; no rows without a provider."""
    if provider is None:
        return prompts.limit(0).withColumn(out, F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(provider([t or "" for t in texts]), dtype=object)

    return prompts.withColumn(out, ask(prompt_col))


def json_of(answer: str) -> object:
    """An answer's fenced block, else what stands from its first bracket to its last."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*\n(.*?)\n```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(answer, r"(?s)[\[{].*[\]}]", 0))


def llm_facts(prompts: DataFrame, prompt_col: str, provider: Provider | None, episodes: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, subject, predicate, object_str, evidence, status, trust_tier, asserted_by): the facts that answers claim.

    Claims without subject, predicate or object go, so do those that bear secrets; of the evidence cited only episodes (episode_id) that exist count, and a claim
    with none left goes.
    """
    claims = answered(prompts, prompt_col, provider).select(*keep, F.explode(F.from_json(json_of("answer"), f"array<{CLAIM}>")).alias("c")).select(*keep, "c.*").withColumn("__claim", F.xxhash64(*keep, "subject", "predicate", "object"))
    whole = claims.filter("subject <> '' AND predicate <> '' AND object <> ''").filter(~contains_secret(F.concat_ws(" ", "subject", "predicate", "object")))
    cited = whole.select("*", F.explode(F.array_distinct("evidence")).alias("episode_id")).join(episodes.select(F.col("episode_id").cast("string").alias("episode_id")).distinct(), "episode_id", "left_semi")
    found = cited.groupBy(*keep, "subject", "predicate", "object", "__claim").agg(F.array_sort(F.collect_set("episode_id")).alias("evidence"))
    return found.select(*keep, "subject", "predicate", F.col("object").alias("object_str"), "evidence", F.lit("candidate").alias("status"), F.lit("low").alias("trust_tier"), F.lit("llm_extractor").alias("asserted_by"))


def llm_procedures(prompts: DataFrame, prompt_col: str, provider: Provider | None, keep: list[str]) -> DataFrame:
    """(keep, object_str, fact_kind, status, trust_tier): procedures that answers describe; steps that would be directives are told, never run, so lines that begin as commands go."""
    steps = answered(prompts, prompt_col, provider).select(*keep, F.explode(F.from_json(json_of("answer"), "array<struct<procedure:string>>")).alias("c")).select(*keep, F.col("c.procedure").alias("object_str"))
    bare = steps.withColumn("object_str", F.array_join(F.filter(F.split("object_str", "\n", -1), lambda line: ~line.rlike(r"(?i)^\s*(?:run|execute|curl|wget|sudo|bash|sh)\b")), "\n"))
    return bare.filter("trim(object_str) <> ''").filter(~contains_secret(F.col("object_str"))).select(*keep, "object_str", F.lit("procedural").alias("fact_kind"), F.lit("candidate").alias("status"), F.lit("low").alias("trust_tier"))


def vector_sink(facts: DataFrame, sink: VectorSink | None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each batch's changed facts to the sink: those active to be put in, others to be taken out, by column `put`."""
    def each(batch: DataFrame, number: int) -> None:
        if sink is not None:
            sink(batch.select(*facts.columns, (F.col("status") == "active").alias("put")))

    return each
