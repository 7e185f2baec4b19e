"""Queries: scans, filters, joins, aggregates, windows, sorts, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofact.functions import scoring as S
from chronofact.functions import text as T
from chronofact.operators import facts as O
from chronofact.plans.registry import Views, query
from chronofact.plans.retrieval import gold

BRIEF = ["fact_id", "subject", "predicate", "status", "fact_kind", "t_recorded"]
SEL = "SELECT fact_id, subject, predicate, status, fact_kind, t_recorded FROM facts"


@query("src_01_point_lookup", "facts anchors", "SELECT f.fact_id, f.subject, a.branch, a.valid_from FROM facts f LEFT JOIN anchors a ON f.fact_id = a.fact_id WHERE f.fact_id = 'fact_00000042'")
def _(v: Views) -> DataFrame:
    return v.facts.filter("fact_id = 'fact_00000042'").join(v.anchors, "fact_id", "left").select("fact_id", "subject", "branch", "valid_from")


@query("src_02_scope_scan", "facts", f"{SEL} WHERE user_id = 'u1' AND workspace_id = 'w1'")
def _(v: Views) -> DataFrame:
    return v.facts.filter(O.scope_clause(user="u1", workspace="w1")).select(*BRIEF)


@query("src_03_active", "facts", f"{SEL} WHERE status = 'active' ORDER BY t_recorded, fact_id LIMIT 50")
def _(v: Views) -> DataFrame:
    return v.facts.filter("status = 'active'").orderBy("t_recorded", "fact_id").limit(50).select(*BRIEF)


@query("src_04_candidates", "facts", f"{SEL} WHERE status = 'candidate'")
def _(v: Views) -> DataFrame:
    return v.facts.filter("status = 'candidate'").select(*BRIEF)


@query("src_05_open_loops", "facts", f"{SEL} WHERE status = 'active' AND fact_kind = 'open_loop'")
def _(v: Views) -> DataFrame:
    return v.facts.filter("status = 'active' AND fact_kind = 'open_loop'").select(*BRIEF)


@query("src_06_user_global", "facts", f"{SEL} WHERE status = 'active' AND workspace_id IS NULL AND session_id IS NULL")
def _(v: Views) -> DataFrame:
    return v.facts.filter("status = 'active' AND workspace_id IS NULL AND session_id IS NULL").select(*BRIEF)


@query("src_07_subject_predicate", "facts", "SELECT a.fact_id AS incoming, b.fact_id AS existing FROM facts a JOIN facts b ON a.user_id = b.user_id AND a.subject = b.subject AND a.predicate = b.predicate WHERE a.status = 'candidate' AND b.status = 'active'")
def _(v: Views) -> DataFrame:
    f = v.facts.select("fact_id", "user_id", "subject", "predicate", "status")
    a, b = f.filter("status = 'candidate'").withColumnRenamed("fact_id", "incoming"), f.filter("status = 'active'").withColumnRenamed("fact_id", "existing")
    return a.join(b, ["user_id", "subject", "predicate"]).select("incoming", "existing")


@query("src_08_malformed_rows", "", "SELECT event_id FROM events WHERE try_cast(props AS json) IS NOT NULL AND event_id % 3 <> 0")
def _(v: Views) -> DataFrame:
    # Every third payload is cut short; rows that don't parse are skipped.
    e = v.table("events").withColumn("payload", F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 3)).otherwise(F.col("props")))
    return e.filter(F.try_parse_json("payload").isNotNull()).select("event_id")


@query("src_09_anchor_arrays", "anchors", "SELECT fact_id, CASE WHEN (valid_from - 1) % 398 % 8 = 6 THEN NULL ELSE 1 END AS n_globs FROM anchors")
def _(v: Views) -> DataFrame:
    # About a quarter of the arrays are malformed. valid_from is always odd, so it is no multiple of four itself.
    raw = F.when((F.col("valid_from") - 1) % 398 % 8 == 6, F.lit("{not an array")).otherwise(F.to_json(F.array("path_glob")))
    return v.anchors.select("fact_id", F.from_json(raw, "array<string>").alias("globs")).select("fact_id", F.when(F.col("globs").isNotNull(), F.size("globs")).alias("n_globs"))


@query("src_10_hydration", "facts anchors", "SELECT f.fact_id, a.branch, a.valid_from, a.path_glob FROM facts f LEFT JOIN anchors a ON f.fact_id = a.fact_id WHERE f.status = 'active'")
def _(v: Views) -> DataFrame:
    return v.facts.filter("status = 'active'").select("fact_id").join(v.anchors, "fact_id", "left").select("fact_id", "branch", "valid_from", "path_glob")


@query("src_11_last_n_episodes", "episodes", "SELECT session_id, episode_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, episode_id DESC) AS rank FROM episodes) WHERE rank <= 8")
def _(v: Views) -> DataFrame:
    return O.top_per(v.episodes, ["session_id"], [F.desc("created_at"), F.desc("episode_id")], 8).select("session_id", "episode_id", "rank")


@query("src_12_edges_touching", "facts fact_edges", "SELECT f.fact_id, e.edge_id, e.edge_kind FROM facts f JOIN fact_edges e ON f.fact_id = e.from_id UNION SELECT f.fact_id, e.edge_id, e.edge_kind FROM facts f JOIN fact_edges e ON f.fact_id = e.to_id")
def _(v: Views) -> DataFrame:
    # Two equality joins rather than one on either end.
    f, e = v.facts.select("fact_id"), v.fact_edges
    ends = [f.join(e.withColumnRenamed(end, "fact_id"), "fact_id").select("fact_id", "edge_id", "edge_kind") for end in ("from_id", "to_id")]
    return ends[0].union(ends[1]).distinct()


@query("src_13_promotions_by_fact", "facts", "SELECT promotion_state, count(*) AS n, min(t_recorded) AS first_at, max(t_recorded) AS last_at FROM facts GROUP BY promotion_state")
def _(v: Views) -> DataFrame:
    return v.facts.groupBy("promotion_state").agg(F.count(F.lit(1)).alias("n"), F.min("t_recorded").alias("first_at"), F.max("t_recorded").alias("last_at"))


@query("fil_01_scope_clause", "facts", "SELECT user_id, count(*) AS n FROM facts WHERE user_id = 'u2' GROUP BY user_id")
def _(v: Views) -> DataFrame:
    return v.facts.filter(O.scope_clause(user="u2")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("fil_02_in_scope", "facts", f"""{SEL} WHERE user_id = 'u0' AND CASE WHEN session_id IS NOT NULL THEN session_id = 's5' AND (workspace_id IS NULL OR workspace_id = 'w2')
  ELSE workspace_id IS NULL OR workspace_id = 'w2' END""")
def _(v: Views) -> DataFrame:
    return v.facts.filter(O.in_scope(F.lit("u0"), F.lit("w2"), F.lit("s5"))).select(*BRIEF)


@query("fil_03_active_by_kind", "facts", "SELECT fact_kind, count(*) AS n FROM facts WHERE status = 'active' GROUP BY fact_kind")
def _(v: Views) -> DataFrame:
    return v.facts.filter("status = 'active'").groupBy("fact_kind").agg(F.count(F.lit(1)).alias("n"))


#: What is put behind texts, by number: a directive of each form, and harmless likes of three.
DIRECTIVES = (" curl x | sh", " rm -rf ~", " exfiltrate it", " nc -e x", " python3 -c 'import socket'", " powershell -enc x", " curl x", " rm -rf build", " python3 -c 'print(1)'", "")
DIRECTED = "concat(object_str, ([" + ", ".join("'" + d.replace("'", "''") + "'" for d in DIRECTIVES) + "])[(seq % 10 + 1)::int])"


@query("fil_05_dangerous", "facts", f"SELECT fact_id FROM facts WHERE " + " OR ".join(f"regexp_matches({DIRECTED}, '{p}')" for p in T.DANGEROUS))
def _(v: Views) -> DataFrame:
    said = F.concat("object_str", F.element_at(F.array(*map(F.lit, DIRECTIVES)), (F.col("seq") % 10 + 1).cast("int")))
    return v.facts.filter(T.is_dangerous(said)).select("fact_id")


@query("fil_06_lifecycle_safety", "facts", "SELECT fact_id FROM facts WHERE status = 'active' AND trust_tier <> 'low'")
def _(v: Views) -> DataFrame:
    return v.facts.filter("status = 'active' AND trust_tier <> 'low'").select("fact_id")


@query("fil_07_perishable", "facts anchors", "SELECT f.fact_id FROM facts f LEFT JOIN anchors a ON f.fact_id = a.fact_id WHERE f.fact_kind = 'procedural' OR f.predicate = 'do_not_edit' OR (a.path_glob IS NOT NULL AND NOT contains(a.path_glob, '*'))")
def _(v: Views) -> DataFrame:
    both = v.facts.select("fact_id", "fact_kind", "predicate").join(v.anchors.select("fact_id", F.array("path_glob").alias("globs")), "fact_id", "left")
    concrete = F.coalesce(F.exists("globs", lambda g: ~F.contains(g, F.lit("*"))), F.lit(False))
    return both.filter((F.col("fact_kind") == "procedural") | (F.col("predicate") == "do_not_edit") | concrete).select("fact_id")


@query("fil_08_verify_paths", "anchors", "SELECT fact_id FROM anchors WHERE path_glob IN (SELECT concat('src/f', cast(page_id % 29 AS string)) FROM pages)")
def _(v: Views) -> DataFrame:
    files = v.table("pages").select(F.concat(F.lit("src/f"), (F.col("page_id") % 29).cast("string")).alias("path_glob"))
    missing = v.anchors.join(files, "path_glob", "left_anti").select("fact_id").distinct()
    return v.anchors.join(missing, "fact_id", "left_anti").select("fact_id")


@query("fil_09_target_removed", "anchors", "SELECT fact_id FROM anchors WHERE path_glob NOT IN (SELECT concat('src/f', cast(page_id % 29 AS string)) FROM pages)")
def _(v: Views) -> DataFrame:
    files = v.table("pages").select(F.concat(F.lit("src/f"), (F.col("page_id") % 29).cast("string")).alias("path_glob"), F.lit(True).alias("there")).distinct()
    return v.anchors.join(files, "path_glob", "left").groupBy("fact_id").agg(F.bool_and(F.col("there").isNull()).alias("gone")).filter("gone").select("fact_id")


@query("fil_10_requires_git", "facts anchors", "SELECT f.fact_id, a.fact_id IS NOT NULL AS requires_git FROM facts f LEFT JOIN anchors a ON f.fact_id = a.fact_id")
def _(v: Views) -> DataFrame:
    both = v.facts.select("fact_id").join(v.anchors, "fact_id", "left")
    return both.select("fact_id", F.coalesce("repo_id", "branch", F.col("introduced_by").cast("string"), F.col("valid_from").cast("string"), F.col("valid_until").cast("string")).isNotNull().alias("requires_git"))


@query("fil_11_glob", "anchors", "SELECT fact_id FROM anchors WHERE regexp_matches(path_glob, '^src/f[^/]*3$')")
def _(v: Views) -> DataFrame:
    return v.anchors.withColumn("g", F.lit("src/f*3")).filter(F.regexp_like("path_glob", T.glob_regex(F.col("g")))).select("fact_id")


@query("fil_13_managed", "facts", "SELECT fact_id FROM facts WHERE status = 'active' AND trust_tier = 'high' AND asserted_by = 'deterministic_parser' AND workspace_id IS NOT NULL")
def _(v: Views) -> DataFrame:
    return v.facts.filter("status = 'active' AND trust_tier = 'high' AND asserted_by = 'deterministic_parser' AND workspace_id IS NOT NULL").select("fact_id")


@query("fil_14_boot", "facts", "SELECT fact_id FROM facts WHERE status = 'active' AND session_id IS NULL AND trust_tier = 'high' AND sensitivity <> 'secret'")
def _(v: Views) -> DataFrame:
    return v.facts.filter("status = 'active' AND session_id IS NULL AND trust_tier = 'high' AND sensitivity <> 'secret'").select("fact_id")


@query("jon_02_anchor_predicate", "facts anchors", "SELECT f.fact_id, a.valid_until FROM facts f JOIN anchors a ON f.fact_id = a.fact_id WHERE a.valid_until IS NOT NULL AND f.status IN ('expired', 'superseded')")
def _(v: Views) -> DataFrame:
    return v.facts.filter("status IN ('expired', 'superseded')").select("fact_id").join(v.anchors.filter("valid_until IS NOT NULL").select("fact_id", "valid_until"), "fact_id")


@query("jon_05_evidence", "facts episodes", "SELECT f.fact_id, count(e.episode_id) AS resolved, count(*) - count(e.episode_id) AS missing FROM (SELECT fact_id, unnest([seq, seq * 3 + 1, seq * 11]) AS event_id FROM facts) f LEFT JOIN episodes e ON f.event_id = e.episode_id GROUP BY f.fact_id")
def _(v: Views) -> DataFrame:
    cited = v.facts.select("fact_id", F.explode(F.array("seq", F.col("seq") * 3 + 1, F.col("seq") * 11)).alias("episode_id"))
    both = cited.join(v.episodes.select("episode_id", F.lit(1).alias("there")), "episode_id", "left")
    return both.groupBy("fact_id").agg(F.count("there").alias("resolved"), F.count_if(F.col("there").isNull()).alias("missing"))


@query("jon_06_incoming_existing", "facts", "SELECT a.fact_id AS incoming, count(*) AS n_existing FROM facts a JOIN facts b ON a.user_id = b.user_id AND a.subject = b.subject AND a.predicate = b.predicate AND a.fact_id <> b.fact_id WHERE b.status NOT IN ('expired', 'superseded', 'rejected') GROUP BY a.fact_id")
def _(v: Views) -> DataFrame:
    # Each fact meets all open others of its key: counted per key, less itself, so no pair is made.
    open_ = F.count_if(~F.col("status").isin("expired", "superseded", "rejected"))
    f, keys = v.facts.select("fact_id", "user_id", "subject", "predicate", "status"), ["user_id", "subject", "predicate"]
    both = f.join(f.groupBy(*keys).agg(open_.alias("n")), keys)
    return both.select(F.col("fact_id").alias("incoming"), (F.col("n") - (~F.col("status").isin("expired", "superseded", "rejected")).cast("bigint")).alias("n_existing")).filter("n_existing > 0")


@query("jon_07_dedupe_anti", "facts", "SELECT fact_id FROM facts i WHERE status = 'candidate' AND NOT EXISTS (SELECT 1 FROM facts s WHERE s.status <> 'expired' AND s.status <> 'candidate' AND s.subject = i.subject AND s.predicate = i.predicate AND s.object_str = i.object_str AND s.user_id = i.user_id AND s.workspace_id IS NOT DISTINCT FROM i.workspace_id)")
def _(v: Views) -> DataFrame:
    return O.already_known(v.facts.filter("status = 'candidate'"), v.facts.filter("status <> 'candidate'")).select("fact_id")


@query("jon_08_stale_anti", "facts", "SELECT fact_id FROM facts f WHERE status = 'active' AND asserted_by = 'deterministic_parser' AND NOT EXISTS (SELECT 1 FROM facts e WHERE e.seq % 4 = 1 AND e.subject = f.subject AND e.predicate = f.predicate AND e.object_str = f.object_str)")
def _(v: Views) -> DataFrame:
    return O.stale_evidence(v.facts.filter("status = 'active' AND asserted_by = 'deterministic_parser'"), v.facts.filter("seq % 4 = 1")).select("fact_id")


@query("jon_09_recently_injected", "facts injections", "SELECT f.fact_id FROM facts f WHERE f.status = 'active' AND NOT EXISTS (SELECT 1 FROM injections i WHERE i.fact_a = f.fact_id AND 1704067200000 + 72000000 - i.at_ms BETWEEN 0 AND 3599999)")
def _(v: Views) -> DataFrame:
    now = 1704067200000 + 72000000
    recent = v.injections.filter((F.lit(now) - F.col("at_ms")).between(0, 3599999)).select(F.col("fact_a").alias("fact_id")).distinct()
    return v.facts.filter("status = 'active'").join(recent, "fact_id", "left_anti").select("fact_id")


@query("jon_11_injections_facts", "facts injections", "SELECT i.injection_id, i.id AS fact_id, f.subject FROM (SELECT injection_id, unnest([fact_a, fact_b]) AS id FROM injections) i LEFT JOIN facts f ON i.id = f.fact_id")
def _(v: Views) -> DataFrame:
    ids = v.injections.select("injection_id", F.explode(F.array("fact_a", "fact_b")).alias("fact_id"))
    return ids.join(v.facts.select("fact_id", "subject"), "fact_id", "left").select("injection_id", "fact_id", "subject")


@query("jon_13_cited_exist", "facts episodes", "SELECT fact_id FROM facts WHERE seq IN (SELECT episode_id FROM episodes) AND seq * 4 IN (SELECT episode_id FROM episodes)")
def _(v: Views) -> DataFrame:
    cited = v.facts.select("fact_id", F.explode(F.array("seq", F.col("seq") * 4)).alias("episode_id"))
    both = cited.join(v.episodes.select("episode_id", F.lit(True).alias("there")), "episode_id", "left")
    return both.groupBy("fact_id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("all_there")).filter("all_there").select("fact_id")


@query("jon_14_need_match", "facts queries", "SELECT q.item_id, count(f.fact_id) AS n FROM queries q LEFT JOIN facts f ON f.status = 'active' AND contains(f.object_str, q.text) GROUP BY q.item_id")
def _(v: Views) -> DataFrame:
    needs = v.queries
    hits = gold(v.facts.filter("status = 'active'").select("fact_id", "object_str"), needs)
    return needs.select("item_id").join(hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")), "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_01_memory_stats", "facts", """SELECT count(*) AS total, count(*) FILTER (status = 'active') AS status_active, count(*) FILTER (status = 'candidate') AS status_candidate, count(*) FILTER (status = 'expired') AS status_expired,
  count(*) FILTER (status = 'superseded') AS status_superseded, count(*) FILTER (status = 'disputed') AS status_disputed, count(*) FILTER (trust_tier = 'high') AS trust_high, count(*) FILTER (trust_tier = 'low') AS trust_low,
  count(session_id) AS scope_session, count(*) FILTER (session_id IS NULL AND workspace_id IS NOT NULL) AS scope_workspace, count(*) FILTER (session_id IS NULL AND workspace_id IS NULL) AS scope_user,
  count(*) FILTER (fact_kind = 'open_loop') AS open_loops, count(*) FILTER (sensitivity = 'secret') AS secrets FROM facts""")
def _(v: Views) -> DataFrame:
    return O.memory_stats(v.facts)


@query("agg_02_outcomes", "injections", "SELECT outcome, count(*) AS n FROM injections GROUP BY outcome")
def _(v: Views) -> DataFrame:
    raw = v.injections.select(F.to_json(F.struct("outcome")).alias("outcome_json"))
    return raw.select(F.get_json_object("outcome_json", "$.outcome").alias("outcome")).filter("outcome IS NOT NULL").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


OUTCOME_SQL = """WITH x AS (SELECT unnest([fact_a, fact_b]) AS fact_id, outcome FROM injections)
SELECT fact_id, count(*) AS n, count(*) FILTER (outcome = 'helped') AS helped, count(*) FILTER (outcome = 'ignored') AS ignored, count(*) FILTER (outcome = 'harmful') AS harmful,
  round(greatest(-0.75, least(0.75, sum(CASE outcome WHEN 'helped' THEN 1.0 WHEN 'ignored' THEN -0.2 WHEN 'harmful' THEN -1.0 ELSE 0.0 END) / count(*)))::double, 6) AS learned FROM x GROUP BY fact_id"""


def outcome_stats(v: Views) -> DataFrame:
    ids = v.injections.select(F.explode(F.array("fact_a", "fact_b")).alias("fact_id"), "outcome")
    weight = F.when(F.col("outcome") == "helped", 1.0).when(F.col("outcome") == "ignored", -0.2).when(F.col("outcome") == "harmful", -1.0).otherwise(0.0)
    kinds = [F.count_if(F.col("outcome") == k).alias(k) for k in ("helped", "ignored", "harmful")]
    learned = F.round(F.greatest(F.lit(-0.75), F.least(F.lit(0.75), F.avg(weight))), 6).alias("learned")
    return ids.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n"), *kinds, learned)


query("agg_03_outcome_stats", "injections", OUTCOME_SQL)(outcome_stats)


@query("agg_04_conflict_groups", "facts", "SELECT user_id, subject, predicate, count(*) AS n, count(DISTINCT object_str) AS n_values, substr(sha256(concat(subject, '::', predicate)), 1, 8) AS conflict_id FROM facts WHERE status = 'active' GROUP BY ALL HAVING count(DISTINCT object_str) > 1")
def _(v: Views) -> DataFrame:
    return O.conflict_groups(v.facts.filter("status = 'active'"))


@query("agg_05_centroid", "", "WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::double AS e FROM embeddings), m AS (SELECT label, i, avg(e) AS e FROM x GROUP BY label, i) SELECT label, i - 1 AS dim, round(e / sqrt(sum(e * e) OVER (PARTITION BY label)), 6) AS value FROM m")
def _(v: Views) -> DataFrame:
    mean = v.table("embeddings").select("label", F.posexplode("embedding").alias("dim", "e")).groupBy("label", "dim").agg(F.avg(F.col("e").cast("double")).alias("e"))
    norm = F.sqrt(F.sum(F.col("e") * F.col("e")).over(W.partitionBy("label")))
    return mean.select("label", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("e") / norm, 6).alias("value"))


@query("agg_06_evidence_merge", "facts", "SELECT user_id, subject, predicate, min(fact_id) AS survivor, cast(sum(evidence_count) AS bigint) AS evidence FROM facts WHERE status = 'active' GROUP BY user_id, subject, predicate")
def _(v: Views) -> DataFrame:
    return v.facts.filter("status = 'active'").groupBy("user_id", "subject", "predicate").agg(F.min("fact_id").alias("survivor"), F.sum("evidence_count").alias("evidence"))


@query("agg_07_latency_dist", "", """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(max(value) FILTER (i = least(n - 1, floor(0.5 * n))), 2) AS p50, round(max(value) FILTER (i = least(n - 1, floor(0.95 * n))), 2) AS p95, round(max(value) FILTER (i = least(n - 1, floor(0.99 * n))), 2) AS p99,
  round(avg(value), 2) AS mean, round(min(value), 2) AS min, round(max(value), 2) AS max FROM o GROUP BY event_type""")
def _(v: Views) -> DataFrame:
    # percentile_disc picks the ceil(p n)-th of the sorted values; the place wanted is floor(p n), counted from 0.
    e = v.table("events").select("event_type", "value")
    counts = e.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(W.partitionBy("event_type").orderBy("value"))
    counts = counts.withColumn("upto", upto).withColumn("n", F.sum("k").over(W.partitionBy("event_type")))
    pick = lambda p: F.round(F.min(F.when(F.col("upto") > S.percentile_index(p, F.col("n")), F.col("value"))), 2).alias(f"p{p}")
    return counts.groupBy("event_type").agg(pick(50), pick(95), pick(99), F.round(F.sum(F.col("value") * F.col("k")) / F.sum("k"), 2).alias("mean"), F.round(F.min("value"), 2).alias("min"), F.round(F.max("value"), 2).alias("max"))


@query("agg_08_confusion", "facts", "WITH x AS (SELECT trust_tier = 'high' AND asserted_by <> 'agent' AS guess, confidence >= 0.5 AS truth FROM facts) SELECT count(*) FILTER (guess AND truth) AS tp, count(*) FILTER (guess AND NOT truth) AS fp, count(*) FILTER (NOT guess AND truth) AS fn, round(count(*) FILTER (guess AND truth) / count(*) FILTER (guess), 6) AS prec, round(count(*) FILTER (guess AND truth) / count(*) FILTER (truth), 6) AS recall FROM x")
def _(v: Views) -> DataFrame:
    g, t = (F.col("trust_tier") == "high") & (F.col("asserted_by") != "agent"), F.col("confidence") >= 0.5
    tp, fp, fn = F.count_if(g & t), F.count_if(g & ~t), F.count_if(~g & t)
    return v.facts.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(tp / (tp + fp), 6).alias("prec"), F.round(tp / (tp + fn), 6).alias("recall"))


@query("agg_11_arms", "injections", "SELECT CASE injection_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS arm, count(*) AS needs, count(*) FILTER (outcome = 'helped') AS solved, round(count(*) FILTER (outcome = 'helped') / count(*), 6) AS solve_rate FROM injections GROUP BY 1")
def _(v: Views) -> DataFrame:
    arm = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("injection_id") % 3 + 1).cast("int"))
    solved = F.count_if(F.col("outcome") == "helped")
    return v.injections.groupBy(arm.alias("arm")).agg(F.count(F.lit(1)).alias("needs"), solved.alias("solved"), F.round(solved / F.count(F.lit(1)), 6).alias("solve_rate"))


@query("agg_12_corpus_stats", "facts", "WITH w AS (SELECT fact_id, list_filter(string_split_regex(lower(object_str), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM facts) SELECT count(*) AS n_docs, round(avg(len(ws)), 6) AS avg_len, max(len(ws)) AS max_len FROM w")
def _(v: Views) -> DataFrame:
    n = F.size(T.words(F.col("object_str"))).cast("bigint")
    return v.facts.select(n.alias("n")).agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("n"), 6).alias("avg_len"), F.max("n").alias("max_len"))


@query("agg_13_pairwise", "injections", """WITH s AS (SELECT fact_a, avg(CASE outcome WHEN 'helped' THEN 1.0 WHEN 'harmful' THEN -1.0 ELSE 0.0 END) AS score, count(*) AS n FROM injections GROUP BY fact_a)
SELECT count(*) AS pairs, round(avg(CASE WHEN h.score > l.score THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s h JOIN s l ON h.n > l.n""")
def _(v: Views) -> DataFrame:
    # How often the more used of two facts scores higher: ranks and running counts stand in for the pairs.
    score = F.avg(F.when(F.col("outcome") == "helped", 1.0).when(F.col("outcome") == "harmful", -1.0).otherwise(0.0))
    s = v.injections.groupBy("fact_a").agg(score.alias("score"), F.count(F.lit(1)).alias("n"))
    cells = s.groupBy("n", "score").agg(F.count(F.lit(1)).alias("k"))
    hi, lo = cells.select(F.col("n").alias("hn"), F.col("score").alias("hs"), F.col("k").alias("hk")), cells
    both = hi.join(lo, F.col("hn") > F.col("n")).select((F.col("hk") * F.col("k")).alias("w"), (F.col("hs") > F.col("score")).alias("won"))
    return both.agg(F.sum("w").alias("pairs"), F.round(F.sum(F.when(F.col("won"), F.col("w")).otherwise(0)) / F.sum("w"), 6).alias("accuracy"))


@query("agg_15_strongest_hit", "injections", "SELECT session_id, fact_a AS fact_id, max(injection_id) AS best, max(CASE WHEN outcome = 'helped' THEN 1 ELSE 0 END) AS answered FROM injections GROUP BY session_id, fact_a")
def _(v: Views) -> DataFrame:
    return v.injections.groupBy("session_id", F.col("fact_a").alias("fact_id")).agg(F.max("injection_id").alias("best"), F.max(F.when(F.col("outcome") == "helped", 1).otherwise(0)).alias("answered"))


@query("win_04_winner_runner_up", "facts", """WITH r AS (SELECT fact_id, user_id, subject, predicate, object_str, CASE WHEN asserted_by = 'user' AND coalesce(session_id = 's4', false) THEN 1 WHEN asserted_by = 'deterministic_parser' AND trust_tier = 'high' THEN 2
  WHEN asserted_by = 'deterministic_parser' THEN 8 WHEN promotion_state = 'workspace_active' THEN 3 WHEN starts_with(promotion_state, 'user_static') THEN 4 WHEN starts_with(promotion_state, 'user_dynamic') THEN 5 WHEN asserted_by = 'agent' THEN 7 ELSE 6 END AS prec FROM facts WHERE status = 'active'),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, subject, predicate ORDER BY prec, concat(subject, '::', predicate, '::', object_str), fact_id) AS rank FROM r)
SELECT user_id, subject, predicate, fact_id, prec, rank FROM n WHERE rank <= 2""")
def _(v: Views) -> DataFrame:
    rank = S.precedence_rank(F.col("asserted_by"), F.col("trust_tier"), F.col("promotion_state"), F.col("tags_text"), F.col("session_id"), F.lit("s4"))
    f = v.facts.filter("status = 'active'").withColumn("prec", rank)
    key = T.content_key(F.col("subject"), F.col("predicate"), F.col("object_str"))
    return O.top_per(f, ["user_id", "subject", "predicate"], [F.col("prec"), key, F.col("fact_id")], 2).select("user_id", "subject", "predicate", "fact_id", "prec", "rank")


@query("win_05_rolling_context", "episodes", "SELECT session_id, episode_id, count(*) OVER w AS n_context, min(episode_id) OVER w AS oldest FROM episodes WINDOW w AS (PARTITION BY session_id ORDER BY created_at, episode_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
def _(v: Views) -> DataFrame:
    w = W.partitionBy("session_id").orderBy("created_at", "episode_id").rowsBetween(-7, 0)
    return v.episodes.select("session_id", "episode_id", F.count(F.lit(1)).over(w).alias("n_context"), F.min("episode_id").over(w).alias("oldest"))


@query("win_06_first_definition", "facts", "SELECT predicate, lang, arg_min(fact_id, seq) AS home FROM facts GROUP BY predicate, lang")
def _(v: Views) -> DataFrame:
    return v.facts.groupBy("predicate", "lang").agg(F.min_by("fact_id", "seq").alias("home"))


@query("win_07_first_in_score_order", "facts", "SELECT subject, predicate, fact_id FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY confidence DESC, fact_id) AS r FROM facts WHERE status = 'active') WHERE r = 1")
def _(v: Views) -> DataFrame:
    return O.top_per(v.facts.filter("status = 'active'"), ["subject", "predicate"], [F.desc("confidence"), F.col("fact_id")], 1).select("subject", "predicate", "fact_id")


@query("srt_04_learned_rank", "injections facts", f"{OUTCOME_SQL.replace('SELECT fact_id, count(*) AS n,', ', s AS (SELECT fact_id, count(*) AS n,', 1)}) SELECT f.fact_id, round(f.confidence * (1 + coalesce(s.learned, 0)), 6) AS score FROM facts f LEFT JOIN s ON f.fact_id = s.fact_id WHERE f.status = 'active' ORDER BY 2 DESC, 1 LIMIT 25")
def _(v: Views) -> DataFrame:
    both = v.facts.filter("status = 'active'").select("fact_id", "confidence").join(outcome_stats(v), "fact_id", "left")
    return both.select("fact_id", F.round(F.col("confidence") * (1 + F.coalesce("learned", F.lit(0.0))), 6).alias("score")).orderBy(F.desc("score"), "fact_id").limit(25)


_LEARNED = OUTCOME_SQL.replace("SELECT fact_id, count(*) AS n,", ", s AS (SELECT fact_id, count(*) AS n,", 1) + ")"


@query("evl_09_rerank_lift", "injections facts", f"""{_LEARNED}, r AS (SELECT f.user_id, s.learned > 0 AS good, f.confidence AS base, round(f.confidence * (1 + s.learned), 6) AS lrn FROM facts f JOIN s ON s.fact_id = f.fact_id WHERE s.learned <> 0)
SELECT count(*) AS pairs, round(avg(CASE WHEN p.base > d.base THEN 1.0 ELSE 0.0 END), 6) AS baseline, round(avg(CASE WHEN p.lrn > d.lrn THEN 1.0 ELSE 0.0 END), 6) AS learned FROM r p JOIN r d ON p.user_id = d.user_id AND p.good AND NOT d.good""")
def _(v: Views) -> DataFrame:
    # How often a fact that helped stands above one that didn't, before and after learning: counted down the order, not by pairs.
    r = v.facts.select("fact_id", "user_id", F.col("confidence").alias("base")).join(outcome_stats(v).filter("learned <> 0"), "fact_id")
    r = r.select("user_id", "base", F.round(F.col("base") * (1 + F.col("learned")), 6).alias("lrn"), (F.col("learned") > 0).cast("bigint").alias("good"))
    for c in ("base", "lrn"):
        upto = F.sum("good").over(W.partitionBy("user_id").orderBy(F.desc(c)).rangeBetween(W.unboundedPreceding, W.currentRow))
        r = r.withColumn(f"above_{c}", upto - F.sum("good").over(W.partitionBy("user_id", c)))
    r = r.withColumn("all_good", F.sum("good").over(W.partitionBy("user_id"))).filter("good = 0")
    share = lambda c: F.round(F.try_divide(F.sum(c), F.sum("all_good")), 6)  # noqa: E731  null without pairs
    return r.agg(F.coalesce(F.sum("all_good"), F.lit(0)).alias("pairs"), share("above_base").alias("baseline"), share("above_lrn").alias("learned"))


@query("srt_05_boot_order", "facts", "SELECT fact_id, CASE fact_kind WHEN 'constraint' THEN 3 WHEN 'procedural' THEN 2 ELSE 1 END AS priority FROM facts WHERE status = 'active' AND session_id IS NULL AND trust_tier = 'high' AND sensitivity <> 'secret' ORDER BY 2 DESC, t_recorded DESC, fact_id LIMIT 12")
def _(v: Views) -> DataFrame:
    f = v.facts.filter("status = 'active' AND session_id IS NULL AND trust_tier = 'high' AND sensitivity <> 'secret'")
    priority = F.when(F.col("fact_kind") == "constraint", 3).when(F.col("fact_kind") == "procedural", 2).otherwise(1)
    return f.select("fact_id", priority.alias("priority"), "t_recorded").orderBy(F.desc("priority"), F.desc("t_recorded"), "fact_id").limit(12).select("fact_id", "priority")


@query("set_02_broad_fill", "facts", "SELECT fact_id, max(fill) AS fill FROM (SELECT fact_id, 0.30 AS fill FROM facts WHERE status = 'active' AND user_id = 'u1' AND workspace_id = 'w1' UNION ALL SELECT fact_id, 0.45 FROM facts WHERE status = 'active' AND user_id = 'u1' AND workspace_id IS NULL AND session_id IS NULL UNION ALL SELECT fact_id, 0.50 FROM facts WHERE status = 'active' AND user_id = 'u1' AND session_id = 's4') GROUP BY fact_id")
def _(v: Views) -> DataFrame:
    # One scan: each fact takes the best fill of the scopes it is in.
    fill = F.array_max(F.array(
        F.when(F.col("workspace_id") == "w1", 0.30), F.when(F.col("workspace_id").isNull() & F.col("session_id").isNull(), 0.45), F.when(F.col("session_id") == "s4", 0.50)))
    return v.facts.filter("status = 'active' AND user_id = 'u1'").select("fact_id", fill.alias("fill")).filter("fill IS NOT NULL")


@query("set_03_conflict_candidates", "facts", "SELECT DISTINCT fact_id FROM facts WHERE status = 'active' AND user_id = 'u1' AND ((workspace_id IS NULL AND session_id IS NULL) OR (workspace_id = 'w1' AND session_id IS NULL) OR session_id = 's4')")
def _(v: Views) -> DataFrame:
    f = v.facts.filter("status = 'active' AND user_id = 'u1'").select("fact_id", "workspace_id", "session_id")
    parts = [f.filter("workspace_id IS NULL AND session_id IS NULL"), f.filter("workspace_id = 'w1' AND session_id IS NULL"), f.filter("session_id = 's4'")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["fact_id"]).select("fact_id")


@query("set_04_force_open_loops", "facts", "WITH top AS (SELECT fact_id FROM facts WHERE status = 'active' ORDER BY confidence DESC, fact_id LIMIT 20) SELECT fact_id, 'selected' AS how FROM top UNION ALL SELECT fact_id, 'forced' FROM facts WHERE status = 'active' AND fact_kind = 'open_loop' AND fact_id NOT IN (SELECT fact_id FROM top)")
def _(v: Views) -> DataFrame:
    active = v.facts.filter("status = 'active'")
    top = active.orderBy(F.desc("confidence"), "fact_id").limit(20).select("fact_id")
    forced = active.filter("fact_kind = 'open_loop'").select("fact_id").join(F.broadcast(top), "fact_id", "left_anti")
    return top.withColumn("how", F.lit("selected")).unionByName(forced.withColumn("how", F.lit("forced")))


@query("set_06_registry_diff", "facts", "SELECT s.subject AS name, 'missing' AS side FROM (SELECT DISTINCT subject FROM facts WHERE seq % 2 = 0) s WHERE s.subject NOT IN (SELECT subject FROM facts WHERE seq % 7 = 1) UNION ALL SELECT s.subject, 'extra' FROM (SELECT DISTINCT subject FROM facts WHERE seq % 7 = 1) s WHERE s.subject NOT IN (SELECT subject FROM facts WHERE seq % 2 = 0)")
def _(v: Views) -> DataFrame:
    want, have = (v.facts.filter(c).select(F.col("subject").alias("name")).distinct() for c in ("seq % 2 = 0", "seq % 7 = 1"))
    return want.exceptAll(have).withColumn("side", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("side", F.lit("extra")))


@query("set_07_cited_valid", "facts", "SELECT fact_id, len(list_intersect([seq, seq + 1, seq + 2], [seq + 1, seq + 2, seq + 3])) AS n FROM facts WHERE status = 'candidate'")
def _(v: Views) -> DataFrame:
    cited, valid = F.array(*[F.col("seq") + i for i in range(3)]), F.array(*[F.col("seq") + i for i in range(1, 4)])
    return v.facts.filter("status = 'candidate'").select("fact_id", F.size(F.array_intersect(cited, valid)).cast("bigint").alias("n"))
