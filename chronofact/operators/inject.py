"""Injection planning: the gate, budgets, greedy selection, conflicts, capsules, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.functions import text as T
from chronofact.functions.secrets import redact, safe_for_send
from chronofact.operators.facts import top_per
from chronofact.storage import join_by_key, materialise

#: Token caps per event, the total, cards per capsule.
EVENT_CAPS = {"SessionStart": 2000, "UserPromptSubmit": 1800, "PreToolUse": 450, "PostToolUse": 700, "PostCompact": 3500}
TOTAL_BUDGET, MAX_CARDS, MAX_CARDS_PRETOOL = 2500, 15, 5
DRIFT_THRESHOLD = 0.35
#: Commands that memory may tell something about.
SHELL_TOOLS = r"\b(npm|pnpm|yarn|bun|node|tsx|tsc|vitest|jest|mocha|uv|poetry|pip|pytest|tox|nox|hatch|ruff|mypy|pyright|biome|eslint|prettier|cargo|go\s+test|make|cmake|docker|docker-compose|git)\b"
FILE_TOOLS = r"\b(rm|mv|cp|chmod|chown|ln)\b"
#: What a precedence is called, by rank.
RANKS = ("safety", "current-session user instruction", "repo structured evidence", "workspace decision", "user static profile", "user dynamic profile", "older session memory", "agent inference", "repo prose")
TITLES = {
    "open_loops": "Open loops / unfinished work", "task_state": "Task state", "repo_constraints": "Repo constraints",
    "procedure": "Applicable procedure", "user_preferences": "User preferences", "conflict_notes": "Conflict notes",
}


def should_fire(event: Column, drift: Column, new_entities: Column, entities: Column, tool: Column, args: Column, success: Column) -> Column:
    """drift is null without a drift signal."""
    name = F.lower(F.coalesce(tool, F.lit("")))
    shell, edit = name.rlike("bash|shell|run"), name.rlike("edit|write|create")
    some_args = F.length(F.coalesce(args, F.lit(""))) > 2
    prompt = F.coalesce(drift > DRIFT_THRESHOLD, F.lit(False)) | F.coalesce(new_entities, F.lit(False)) | (drift.isNull() & (entities > 0))
    pretool = F.when(edit, some_args | (entities > 0)).when(shell, some_args & F.coalesce(F.lower(args).rlike(SHELL_TOOLS) | F.lower(args).rlike(FILE_TOOLS), F.lit(False))).otherwise(False)
    return (
        F.when(event.isin("SessionStart", "PostCompact"), True).when(event == "UserPromptSubmit", prompt).when(event == "PreToolUse", pretool)
        .when(event == "PostToolUse", F.coalesce(~success, F.lit(False))).otherwise(False)
    )


def budget(event: Column, override: Column, context_window: Column | None = None, fraction: float = 0.015) -> Column:
    cap = F.coalesce(F.create_map(*[x for k, v in EVENT_CAPS.items() for x in (F.lit(k), F.lit(v))])[event], F.lit(TOTAL_BUDGET))
    least = F.least(cap, F.lit(TOTAL_BUDGET)) if context_window is None else F.least(cap, F.lit(TOTAL_BUDGET), F.floor(context_window * fraction).cast("int"))
    return F.when(override > 0, override).otherwise(least)


def must_include(kind: Column, asserted_by: Column) -> Column:
    return F.when(kind == "open_loop", 2).otherwise(0) + F.when(asserted_by == "user", 1).otherwise(0)


def placed(cards: DataFrame, by: str) -> DataFrame:
    """cards with __g (hash of by) and place, their number in the query's order; ranges of the order are numbered apart, so no task holds a query's cards."""
    order = [F.desc("priority"), F.desc("score"), F.col("key"), F.col("fact_id")]
    dealt = cards.withColumn("__g", F.xxhash64(by)).repartitionByRange("__g", *order).withColumn("__p", F.spark_partition_id())
    dealt = materialise(dealt)
    before = W.partitionBy("__g").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    starts = materialise(dealt.groupBy("__g", "__p").agg(F.count(F.lit(1)).alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c"))
    numbered = dealt.withColumn("__i", F.row_number().over(W.partitionBy("__g", "__p").orderBy(*order)))
    return numbered.join(starts, ["__g", "__p"]).withColumn("place", (F.col("__i") + F.col("__before")).cast("int")).drop("__p", "__i", "__before")


def greedy(cards: DataFrame, by: str, budget_tokens: int, max_cards: int) -> DataFrame:
    """(by, fact_id, reason, place): each query's cards in order of priority, score and key; a card that doesn't fit is skipped, later ones may fit.

    cards: by, fact_id, subject, predicate, priority, score, key, tokens. All cards get their reason: selected, max_cards, budget or
    redundant. Each of at most max_cards passes finds every query's next card that fits; nothing folds over a query's cards.
    """
    slot = F.concat_ws("::", "subject", "predicate").alias("slot")
    rows = materialise(placed(cards.select(by, "fact_id", "priority", "score", "key", slot, F.col("tokens").cast("bigint").alias("tokens")), by).select(by, "__g", "fact_id", "slot", "tokens", "place"))
    taken = F.array().cast("array<struct<place:int,slot:string,tokens:bigint>>")
    state = materialise(rows.groupBy("__g").agg(F.count(F.lit(1)).alias("__c")).withColumn("__taken", taken))
    total = rows.count()
    used = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda acc, x: acc + x["tokens"])
    known = lambda xs: F.exists(xs, lambda x: x["slot"] == F.col("slot"))
    for _ in range(max_cards):
        both = join_by_key(rows, state, ["__g"], "__c", total, F.col("fact_id"))
        last = F.coalesce(F.try_element_at("__taken", F.lit(-1))["place"], F.lit(0))
        fits = both.filter((F.col("place") > last) & (used(F.col("__taken")) + F.col("tokens") <= budget_tokens) & ~known(F.col("__taken")))
        found = materialise(fits.groupBy("__g").agg(F.min(F.struct("place", "slot", "tokens")).alias("__x")))
        if not found.take(1):
            break
        state = materialise(state.join(found, "__g", "left").select("__g", "__c", F.when(F.col("__x").isNull(), F.col("__taken")).otherwise(F.concat("__taken", F.array("__x"))).alias("__taken")))
    both = join_by_key(rows, state, ["__g"], "__c", total, F.col("fact_id"))
    both = both.withColumn("__before", F.filter("__taken", lambda x: x["place"] < F.col("place")))
    reason = (
        F.when(F.size("__before") >= max_cards, "max_cards").when(used(F.col("__before")) + F.col("tokens") > budget_tokens, "budget")
        .when(known(F.col("__before")), "redundant").otherwise("selected")
    )
    return both.select(by, "fact_id", reason.alias("reason"), "place")


def verified(facts: DataFrame, anchors: DataFrame, files: DataFrame) -> DataFrame:
    """Facts but for perishable ones (procedures, do_not_edit, or anchored to concrete paths) all of whose concrete paths are gone. anchors: fact_id, path_glob; files: path_glob."""
    paths = anchors.filter(~F.contains("path_glob", F.lit("*"))).select("fact_id", "path_glob").distinct()
    there = paths.join(files.select("path_glob").distinct().withColumn("__there", F.lit(True)), "path_glob", "left")
    gone = there.groupBy("fact_id").agg(F.bool_and(F.col("__there").isNull()).alias("__gone")).filter("__gone").select("fact_id")
    return facts.join(gone, "fact_id", "left_anti")


def not_recent(facts: DataFrame, injected: DataFrame, now_ms: int, by: list[str], ttl_ms: int = 3_600_000) -> DataFrame:
    """Facts that weren't injected within the time; open loops come again. injected: by, fact_id, at_ms."""
    recent = injected.filter((F.lit(now_ms) - F.col("at_ms")).between(0, ttl_ms - 1)).select(*by, "fact_id").distinct()
    again = facts.filter("fact_kind = 'open_loop'")
    return facts.filter("fact_kind <> 'open_loop'").join(recent, [*by, "fact_id"], "left_anti").unionByName(again)


def lifecycle_safe(trust: Column, event: Column) -> Column:
    """Before a tool runs only trusted facts are told."""
    return (event != "PreToolUse") | (trust != "low")


def plan(scored: DataFrame, by: str, event: str, anchors: DataFrame, files: DataFrame, injected: DataFrame, now_ms: int, budget_tokens: int | None = None) -> DataFrame:
    """(by, fact_id, section, place, reason, card): what is told at an event, a row a card, and what isn't, with its reason and no card.

    scored: retrieved valid facts with by, fact_id, subject, predicate, object_str, raw_quote, tags_text, fact_kind, trust_tier, sensitivity, promotion_state, asserted_by, prec, key, score. In
    order: perishable facts are verified, unsafe ones dropped, then what the event doesn't suit and what was just told; conflicts are resolved; the budget is filled;
    at boot and after compaction open loops that it left out are told all the same ('forced').
    """
    return fill(candidates(scored, by, event, anchors, files, injected, now_ms), by, event, budget_tokens)


def candidates(scored: DataFrame, by: str, event: str, anchors: DataFrame, files: DataFrame, injected: DataFrame, now_ms: int) -> DataFrame:
    """What may be told, before conflicts and the budget: a written table."""
    rows = verified(scored, anchors, files)
    rows = rows.filter(safe_for_send(F.col) & lifecycle_safe(F.col("trust_tier"), F.lit(event)))
    return materialise(not_recent(rows, injected, now_ms, [by]))


def fill(rows: DataFrame, by: str, event: str, budget_tokens: int | None = None) -> DataFrame:
    """The rest of plan, from candidates."""
    won = resolve_conflicts(rows.select(by, "subject", "predicate", "fact_id", F.sha2("object_str", 256).alias("object_hash"), "prec", "key"), [by])
    body = T.card_body(*[F.col(c) for c in ("subject", "predicate", "object_str", "fact_kind", "trust_tier")], F.lit(""))
    cards = rows.join(won.select(by, F.col("winner").alias("fact_id")), [by, "fact_id"], "left_semi").withColumn("card", T.card(F.col("fact_id"), body))
    cards = cards.withColumn("tokens", T.estimate_tokens(F.col("card"))).withColumn("section", T.section(F.col("fact_kind"), F.col("promotion_state")))
    cards = materialise(cards.withColumn("priority", must_include(F.col("fact_kind"), F.col("asserted_by"))))
    most = min(EVENT_CAPS.get(event, TOTAL_BUDGET), TOTAL_BUDGET) if budget_tokens is None else budget_tokens
    chosen = greedy(cards, by, most, MAX_CARDS_PRETOOL if event == "PreToolUse" else MAX_CARDS)
    out = chosen.join(cards.select(by, "fact_id", "section", "fact_kind", "card"), [by, "fact_id"])
    forced = (F.col("fact_kind") == "open_loop") & (F.col("reason") != "selected") & F.lit(event in ("SessionStart", "PostCompact"))
    out = out.withColumn("reason", F.when(forced, "forced").otherwise(F.col("reason")))
    return out.select(by, "fact_id", "section", "place", "reason", F.when(F.col("reason").isin("selected", "forced"), F.col("card")).alias("card"))


def injection_log(planned: DataFrame, by: str) -> DataFrame:
    """(by, n_selected, n_omitted, tokens) of a plan."""
    told = F.col("card").isNotNull()
    return planned.groupBy(by).agg(F.count_if(told).alias("n_selected"), F.count_if(~told).alias("n_omitted"), F.coalesce(F.sum(F.when(told, T.estimate_tokens(F.col("card")))), F.lit(0)).alias("tokens"))


def resolve_conflicts(facts: DataFrame, by: list[str]) -> DataFrame:
    """Per (by, subject, predicate) the best by precedence, with the number of different values and the runner-up among others."""
    order = [F.col("prec"), F.col("key"), F.col("fact_id")]
    slot = [*by, "subject", "predicate"]
    best = top_per(facts, slot, order, 1).drop("rank").withColumnRenamed("fact_id", "winner").withColumnRenamed("object_hash", "won").withColumnRenamed("prec", "winner_prec")
    others = facts.join(best.select(*slot, "won"), slot).filter(F.col("object_hash") != F.col("won"))
    runner = top_per(others, slot, order, 1).select(*slot, F.col("fact_id").alias("runner_up"), F.col("prec").alias("runner_prec"))
    values = facts.groupBy(*slot).agg(F.countDistinct("object_hash").alias("n_values"))
    return best.join(values, slot).join(runner, slot, "left").select(*slot, "winner", "winner_prec", "runner_up", "runner_prec", "n_values")


def conflict_notes(facts: DataFrame, by: list[str]) -> DataFrame:
    """(by, fact_id, conflict_id, note): for each slot with several values, why the winner (fact_id) beat the best of another value; redacted, repository prose as a claim.

    facts: by, subject, predicate, fact_id, object_str, trust_tier, asserted_by, prec, key. Values go by hash until the two that are told are known.
    """
    slim = facts.select(*by, "subject", "predicate", "fact_id", F.sha2("object_str", 256).alias("object_hash"), "prec", "key")
    pairs = materialise(resolve_conflicts(slim, by).filter("runner_up IS NOT NULL"))
    value = redact(F.col("object_str"))
    shown = F.when((F.col("trust_tier") == "low") & (F.col("asserted_by") == "deterministic_parser"), T.claim(value)).otherwise(value)
    quoted = F.substring(F.to_json(F.array(shown)), F.lit(2), F.length(F.to_json(F.array(shown))) - 2)
    texts = lambda name: facts.select(*by, F.col("fact_id").alias(name), quoted.alias(f"__{name}")).distinct()
    both = pairs.join(texts("winner"), [*by, "winner"]).join(texts("runner_up"), [*by, "runner_up"])
    label = lambda c: F.coalesce(F.get(F.array(*map(F.lit, RANKS)), F.col(c)), F.lit("memory"))
    reason = F.when(F.col("winner_prec") < F.col("runner_prec"), F.concat(label("winner_prec"), F.lit(" > "), label("runner_prec"))).otherwise("higher precedence")
    note = F.concat(F.lit("Conflicting "), redact(F.concat_ws(" ", "subject", "predicate")), F.lit(": "), "__winner", F.lit(" wins over "), "__runner_up", F.lit(" ("), reason, F.lit(")."))
    return both.select(*by, F.col("winner").alias("fact_id"), T.conflict_id(F.col("subject"), F.col("predicate")).alias("conflict_id"), note.alias("note"))


def capsule(selected: DataFrame, by: str, header: str, notes: DataFrame | None = None) -> DataFrame:
    """(by, markdown): sections in their fixed order, cards in place order; of `selected`: by, fact_id, section, place, card. Last come the notes (by, fact_id, conflict_id, note) on facts that are told."""
    order = F.array_position(F.array(*map(F.lit, T.SECTIONS)), F.col("section"))
    lines = selected.select(by, "section", order.alias("at"), "place", "card")
    if notes is not None:
        told = notes.join(selected.select(by, "fact_id", "place"), [by, "fact_id"])
        line = F.concat(F.lit("- "), "note", F.lit(" [conflict:"), "conflict_id", F.lit("]"))
        lines = lines.unionByName(told.select(by, F.lit("conflict_notes").alias("section"), F.lit(len(T.SECTIONS) + 1).cast("bigint").alias("at"), "place", line.alias("card")))
    lists = lines.groupBy(by, "section", "at").agg(F.array_sort(F.collect_list(F.struct("place", "card"))).alias("cards"))
    title = F.create_map(*[x for k, v in TITLES.items() for x in (F.lit(k), F.lit(v))])[F.col("section")]
    block = F.concat(F.lit("**"), title, F.lit(":**\n"), F.array_join(F.transform("cards", lambda c: c["card"]), "\n"))
    whole = lists.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", block.alias("text")))).alias("blocks"))
    return whole.select(by, F.concat(F.lit(f"## {header}\n\n"), F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n")).alias("markdown"))


def drift(vectors: DataFrame, session: str, order: str, dim: str, value: str, window: int = 8) -> DataFrame:
    """(session, order, drift): cosine distance of each text's sparse vector to the mean of the session's last `window` texts, itself included."""
    texts = vectors.select(session, order).distinct().withColumn("__i", F.row_number().over(W.partitionBy(session).orderBy(order)))
    v = vectors.join(texts, [session, order])
    # Each vector goes to the at most `window` texts whose window holds it.
    last = F.max("__i").over(W.partitionBy(session))
    spread = v.withColumn("__last", last).withColumn("__at", F.explode(F.sequence(F.col("__i"), F.least(F.col("__i") + window - 1, F.col("__last")))))
    mean = spread.groupBy(session, F.col("__at").alias("__i"), dim).agg(F.sum(value).alias("__m"))
    norms = mean.groupBy(session, "__i").agg(F.sqrt(F.sum(F.col("__m") * F.col("__m"))).alias("__norm"))
    dots = v.join(mean, [session, "__i", dim]).groupBy(session, "__i").agg(F.sum(F.col(value) * F.col("__m")).alias("__dot"))
    out = dots.join(norms, [session, "__i"]).join(texts, [session, "__i"])
    return out.select(session, order, (F.round(F.when(F.col("__norm") == 0, 1.0).otherwise(1 - F.col("__dot") / F.col("__norm")), 6) + F.lit(0.0)).alias("drift"))
