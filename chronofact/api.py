"""The store's tools over a folder of Parquet: remember, recall, why, promote, forget, resolve, checkpoint.

Facts are an append-only log of versions, and the current view takes each fact's last one. A call's rows, in however many tables, are named by one
snapshot (`sources/log.py`): they are seen all at once or not at all, and a call that read what another writer changed meanwhile is done again. All calls take batches and return
DataFrames; times and ids are the caller's, never drawn here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.functions import scoring as S
from chronofact.functions import secrets as X
from chronofact.functions import text as T
from chronofact.operators import facts as O
from chronofact.operators import inject as I
from chronofact.operators import lifecycle as L
from chronofact.operators import provenance as P
from chronofact.operators import retrieve as R
from chronofact.operators.index import StoredIndex, vector_of, words_of
from chronofact.sources.log import Snapshot, SnapshotLog
from chronofact.storage import materialise

FACT = (
    "fact_id string, subject string, predicate string, object_str string, fact_kind string, temporal_kind string, status string, promotion_state string, trust_tier string, sensitivity string, asserted_by string, "
    "confidence double, evidence_count bigint, t_recorded bigint, t_expired bigint, invalidated_by string, user_id string, workspace_id string, session_id string, raw_quote string, tags_text string, event_ids array<string>, branch string, path_globs array<string>, contradiction_count bigint, version bigint, t_written bigint"
)
EPISODE = "episode_id string, session_id string, event_type string, payload string, created_at bigint"
EDGE = "from_id string, edge_kind string, to_id string, created_at bigint"
PROMOTION = "fact_id string, from_state string, to_state string, decision string, created_at bigint"
INJECTION = "user_id string, fact_id string, scope_session string, event string, at_ms bigint"
DEFAULTS = {"fact_kind": "semantic", "temporal_kind": "dynamic", "status": "candidate", "promotion_state": "session_only", "trust_tier": "low", "sensitivity": "public", "asserted_by": "agent", "confidence": 0.5, "evidence_count": 1, "tags_text": "", "contradiction_count": 0}
KEYS = ["user_id", "subject", "predicate"]
#: Facts that nothing meets any more.
CLOSED = ("expired", "superseded")


class FactStore:
    """A fact store in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.tables = SnapshotLog(spark, self.folder, {"facts": FACT, "episodes": EPISODE, "edges": EDGE, "promotions": PROMOTION, "injections": INJECTION})

    def log(self, at: Snapshot | None = None) -> DataFrame:
        return (at or self.tables.latest()).read("facts")

    def current(self, at: Snapshot | None = None) -> DataFrame:
        """Each fact's last version."""
        return O.latest(self.log(at), "fact_id", "version")

    def episodes(self) -> DataFrame:
        return self.tables.latest().read("episodes")

    def edges(self) -> DataFrame:
        return self.tables.latest().read("edges")

    def promotions(self) -> DataFrame:
        """Every decision of a sweep, with the state before and after."""
        return self.tables.latest().read("promotions")

    def _versions(self, rows: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], FACT).schema}
        return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    def capture(self, episodes: DataFrame) -> None:
        """Append episodes: episode_id, session_id, event_type, payload, created_at."""
        self.tables.append(episodes=episodes)

    def _sifted(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """First versions of new facts with their defaults, and the rows that bear secrets."""
        said = F.concat_ws(" ", "subject", "predicate", "object_str", *[c for c in ("raw_quote", "tags_text") if c in rows.columns])
        checked = rows.withColumn("__secret", X.contains_secret(said))
        good = checked.filter("not __secret").drop("__secret").withColumn("version", F.lit(1)).withColumn("t_written", F.col("t_recorded"))
        for name, value in DEFAULTS.items():
            good = good.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in good.columns else F.lit(value))
        return self._versions(good), checked.filter("__secret").drop("__secret")

    def remember(self, rows: DataFrame) -> DataFrame:
        """Append new facts with their defaults; rows that bear secrets are refused and returned."""
        good, refused = self._sifted(rows)
        self.tables.append(facts=good)
        return refused

    def learn(self, rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
        """remember, and let each new fact meet the open ones of its user, subject and predicate (`lifecycle.cascade`), in order of time and id. The refused rows.

        New facts, changed versions (as of the key's last arrival) and edges are written at once. Rows whose id is known are passed over, so a batch that is given again changes nothing. With `files` (path_glob),
        the paths there are, a fact all of whose concrete paths are gone gives way to any other value. Facts without user, subject or predicate meet none.
        """
        sifted, refused = self._sifted(rows)

        def build(at: Snapshot) -> dict[str, DataFrame]:
            now = self.current(at)
            new = materialise(sifted.join(now.select("fact_id"), "fact_id", "left_anti"))
            open_ = now.filter(~F.col("status").isin(*CLOSED)).join(new.select(*KEYS).distinct(), KEYS, "left_semi")
            both = materialise(open_.withColumn("incoming", F.lit(False)).unionByName(new.withColumn("incoming", F.lit(True))))
            gone = self._without_targets(both, files)
            feats = L.features(F.col, F.lit(False) if files is None else F.col("__gone"))
            counts = {c: F.coalesce(c, F.lit(0)) for c in ("evidence_count", "contradiction_count")}
            arrivals = gone.dropna(subset=KEYS).select(*KEYS, F.col("t_recorded").alias("seq"), "fact_id", "incoming", "status", *[v.alias(c) for c, v in counts.items()], *[v.alias(c) for c, v in feats.items()])
            out = materialise(L.cascade(arrivals, KEYS))
            fates = out.filter("existing IS NULL").select("fact_id", *[F.col(c).alias(f"__{c}") for c in ("status", "evidence_count", "contradiction_count", "closed_by", "closed_at")])
            last = new.groupBy(*KEYS).agg(F.max("t_recorded").alias("__at"))
            changed = ~(F.col("__status").eqNullSafe(F.col("status")) & F.col("__evidence_count").eqNullSafe(F.coalesce("evidence_count", F.lit(0))) & F.col("__contradiction_count").eqNullSafe(F.coalesce("contradiction_count", F.lit(0))))
            later = both.join(fates, "fact_id").filter(changed).join(last, KEYS)
            set_ = {
                "status": F.col("__status"), "evidence_count": F.col("__evidence_count"), "contradiction_count": F.col("__contradiction_count"), "t_expired": F.coalesce("__closed_at", "t_expired"),
                "invalidated_by": F.coalesce("__closed_by", "invalidated_by"), "t_written": F.greatest("t_written", "__at"), "version": F.col("version") + 1,
            }
            met = out.filter("existing IS NOT NULL").select(F.col("fact_id").alias("incoming"), "existing", "relation", F.lit(True).alias("overrides"))
            edges = L.effects(met, "incoming").join(new.select(F.col("fact_id").alias("incoming"), F.col("t_recorded").alias("created_at")), "incoming")
            return {"facts": new.unionByName(self._versions(later.withColumns(set_))), "edges": edges.select("from_id", "edge_kind", "to_id", "created_at")}

        self.tables.transact(build)
        return refused

    def _without_targets(self, facts: DataFrame, files: DataFrame | None) -> DataFrame:
        """facts with __gone: all concrete paths that they speak of, at least one, are missing from files."""
        if files is None:
            return facts
        own = F.when(F.col("predicate") == "do_not_edit", F.array("subject")).otherwise(F.array().cast("array<string>"))
        paths = facts.select("fact_id", F.explode(F.concat(own, F.filter(F.coalesce("path_globs", F.array().cast("array<string>")), lambda g: ~F.contains(g, F.lit("*"))))).alias("path_glob"))
        there = paths.join(files.select("path_glob").distinct().withColumn("__there", F.lit(True)), "path_glob", "left")
        gone = there.groupBy("fact_id").agg(F.bool_and(F.col("__there").isNull()).alias("__gone"))
        return facts.join(gone, "fact_id", "left")

    def forget(self, ids: DataFrame, at_ms: int) -> None:
        """Expire facts (column fact_id) at the user's wish; each is its own reason."""

        def build(at: Snapshot) -> dict[str, DataFrame]:
            gone = self.current(at).join(ids.select("fact_id").distinct(), "fact_id", "left_semi")
            return {"facts": self._versions(gone.withColumns({"status": F.lit("expired"), "t_expired": F.lit(at_ms), "invalidated_by": F.col("fact_id"), "t_written": F.lit(at_ms), "version": F.col("version") + 1}))}

        self.tables.transact(build)

    def recall(self, queries: DataFrame, user: str, workspace: str | None = None, session: str | None = None, k: int = 15, now_ms: int | None = None, valid: DataFrame | None = None) -> DataFrame:
        """(query_id, fact_id, score, rank) for queries (query_id, text and, if there is one, broad): passes by scope with the queries' expansions, broad fill, short pools filled by meaning; fused,
        weighed by scope, entities, confidence and recency, spread out. Only visible active facts that are safe to send; with `valid` (fact_id), of those only facts valid at the caller's
        head. Words and embeddings are read from indexes beside the log, which take up what was written since.
        """
        facts = self.current()
        parts = [F.col(c) for c in ("subject", "predicate", "object_str")]
        facts = facts.withColumn("key", T.content_key(*parts)).withColumn("index_text", T.fts_text(*parts, F.col("raw_quote")))
        facts = facts.withColumn("semantic_text", T.present(*parts, *[F.col(c) for c in ("raw_quote", "fact_kind", "temporal_kind", "tags_text")]))
        facts = facts.withColumn("passes", R.scope_passes(user, workspace, session)).withColumn("eligible", O.in_scope(F.lit(user), F.lit(workspace), F.lit(session))).withColumn("fill", R.fill_value(workspace, session))
        sound = (F.col("status") == "active") & X.safe_for_send(F.col)
        known = facts.withColumn("valid", sound) if valid is None else facts.join(valid.select("fact_id").distinct().withColumn("__there", F.lit(True)), "fact_id", "left").withColumn("valid", sound & F.coalesce("__there", F.lit(False))).drop("__there")
        asked = queries.withColumn("entities", F.slice(F.filter(T.query_terms(F.col("text")), lambda t: F.length(t) >= 6), 1, 2)).withColumn("user_id", F.lit(user))
        now = F.lit(now_ms) if now_ms is not None else F.col("t_recorded")
        words, vectors = StoredIndex(self.spark, f"{self.folder}/index/words", words_of), StoredIndex(self.spark, f"{self.folder}/index/vectors", vector_of, forward=True)
        ranked = materialise(R.retrieve(known, asked, "query_id", "text", F.lit(session), now, words=words, vectors=vectors).select("query_id", "fact_id", "rank", "score"))
        near = known.join(ranked.filter(F.col("rank") <= R.MMR_POOL).select("fact_id").distinct(), "fact_id", "left_semi")
        return R.mmr(ranked, R.sparse_embedding(near, "fact_id", "semantic_text"), "query_id", "fact_id").filter(F.col("rank") <= k).select("query_id", "fact_id", "score", "rank")

    def inject_context(self, user: str, event: str = "SessionStart", workspace: str | None = None, session: str | None = None, now_ms: int = 0, anchors: DataFrame | None = None, files: DataFrame | None = None, valid: DataFrame | None = None) -> DataFrame:
        """(user_id, markdown): the capsule of a user's visible facts, as `inject.plan` has it, with notes on the conflicts that facts told have won. anchors (fact_id, path_glob), files (path_glob) and valid (fact_id) tell of the work tree, if there is one.

        What is told is recorded, and isn't told again within the hour.
        """
        seen = self.current().filter((F.col("status") == "active") & O.in_scope(F.lit(user), F.lit(workspace), F.lit(session)))
        seen = seen if valid is None else seen.join(valid.select("fact_id").distinct(), "fact_id", "left_semi")
        prec = S.precedence_rank(F.col("asserted_by"), F.col("trust_tier"), F.col("promotion_state"), F.col("tags_text"), F.col("session_id"), F.lit(session))
        scored = seen.withColumn("prec", prec).withColumn("score", F.col("confidence")).withColumn("key", T.content_key(F.col("subject"), F.col("predicate"), F.col("object_str")))
        none = self.spark.createDataFrame([], "fact_id string, path_glob string")
        told = self.injections().filter(F.col("scope_session").eqNullSafe(F.lit(session)))
        return self._told(I.candidates(scored, "user_id", event, none if anchors is None else anchors, none if files is None else files, told, now_ms), "user_id", event, user, session, now_ms)

    def _told(self, rows: DataFrame, by: str, event: str, user: str, session: str | None, now_ms: int) -> DataFrame:
        """The capsules of candidates, recorded."""
        planned = materialise(I.fill(rows, by, event).filter("card IS NOT NULL"))
        once = planned.select("fact_id").distinct()
        self.tables.append(injections=once.select(F.lit(user).alias("user_id"), "fact_id", F.lit(session).cast("string").alias("scope_session"), F.lit(event).alias("event"), F.lit(now_ms).cast("bigint").alias("at_ms")))
        return I.capsule(planned, by, "Relevant memory", I.conflict_notes(rows, [by]))

    def inject_requests(self, requests: DataFrame, event: str, user: str, workspace: str | None = None, session: str | None = None, now_ms: int = 0, anchors: DataFrame | None = None, files: DataFrame | None = None, valid: DataFrame | None = None) -> DataFrame:
        """(request_id, markdown) for prompts and tool calls: those that pass the gate get a capsule of what `recall` finds for them.

        requests: request_id, text, and where known drift, new_entities, entities (their number), tool, args, success. Before a tool only trusted facts are told, at most five. What is told is
        recorded as in inject_context; the requests of one call don't see each other's cards.
        """
        kinds = {"drift": "double", "new_entities": "boolean", "entities": "int", "tool": "string", "args": "string", "success": "boolean"}
        asked = requests.select("request_id", F.coalesce("text", F.lit("")).alias("text"), *[(F.col(c) if c in requests.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
        fires = I.should_fire(F.lit(event), F.col("drift"), F.col("new_entities"), F.coalesce("entities", F.lit(0)), F.col("tool"), F.col("args"), F.coalesce("success", F.lit(True)))
        fired = materialise(asked.filter(fires).select(F.col("request_id").alias("query_id"), F.concat_ws(" ", "text", "args").alias("text")))
        found = self.recall(fired, user, workspace, session, k=R.MMR_POOL, now_ms=now_ms, valid=valid)
        facts = self.current()
        prec = S.precedence_rank(F.col("asserted_by"), F.col("trust_tier"), F.col("promotion_state"), F.col("tags_text"), F.col("session_id"), F.lit(session))
        scored = found.select(F.col("query_id").alias("request_id"), "fact_id", "score").join(facts, "fact_id").withColumn("prec", prec).withColumn("key", T.content_key(F.col("subject"), F.col("predicate"), F.col("object_str")))
        told = self.injections().filter(F.col("scope_session").eqNullSafe(F.lit(session)) & (F.col("user_id") == user))
        none = self.spark.createDataFrame([], "fact_id string, path_glob string")
        fresh = I.not_recent(scored, told.drop("user_id"), now_ms, [])
        empty = self.spark.createDataFrame([], "request_id string, fact_id string, at_ms bigint").withColumn("request_id", F.col("request_id").cast(scored.schema["request_id"].dataType))
        return self._told(I.candidates(fresh, "request_id", event, none if anchors is None else anchors, none if files is None else files, empty, now_ms), "request_id", event, user, session, now_ms)

    def injections(self) -> DataFrame:
        """What was told, to whom and when."""
        return self.tables.latest().read("injections")

    def why(self, ids: DataFrame, as_of_ms: int | None = None) -> DataFrame:
        """Provenance of facts (column fact_id) at a glance: last version, evidence found, ids missing, whether the chain is whole. Quotes are redacted. Nothing that was written later."""
        facts = self.log().join(ids.select("fact_id").distinct(), "fact_id", "left_semi")
        if as_of_ms is not None:
            facts = facts.filter(F.coalesce("t_written", "t_recorded") <= as_of_ms)
        last = O.latest(facts, "fact_id", "version")
        cited = last.select("fact_id", F.explode("event_ids").alias("episode_id"))
        found = cited.join(self.episodes().select("episode_id", "created_at"), "episode_id", "left")
        late = F.lit(False) if as_of_ms is None else F.col("created_at") > as_of_ms
        counts = found.groupBy("fact_id").agg(
            F.array_sort(F.collect_list(F.when(F.col("created_at").isNotNull() & ~late, F.col("episode_id")))).alias("evidence"),
            F.array_sort(F.collect_list(F.when(F.col("created_at").isNull(), F.col("episode_id")))).alias("missing"), F.count_if(F.coalesce(late, F.lit(False))).alias("__late"),
        )
        none = F.array().cast("array<string>")
        out = last.join(counts, "fact_id", "left")
        return out.select("fact_id", "asserted_by", X.redact(F.col("raw_quote")).alias("raw_quote"), "status", "version", F.coalesce("evidence", none).alias("evidence"), F.coalesce("missing", none).alias("missing"), (F.coalesce(F.size("missing"), F.lit(0)) + F.coalesce("__late", F.lit(0)) == 0).alias("complete"))

    def provenance(self, ids: DataFrame, depth: int = 3, as_of_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The whole report: (root, fact_id, hop) of what facts (column fact_id) superseded or rest on, and (fact_id, part, line) of every fact on the way, redacted. Nothing that was written later."""
        at = self.tables.latest()
        past = lambda df, c: df if as_of_ms is None else df.filter(F.col(c) <= as_of_ms)
        edges = past(at.read("edges"), "created_at")
        facts = O.latest(past(at.read("facts").withColumn("t_written", F.coalesce("t_written", "t_recorded")), "t_written"), "fact_id", "version")
        hops = P.chain(ids.join(facts.select("fact_id"), "fact_id", "left_semi"), edges, depth)
        met = materialise(facts.join(hops.select("fact_id").distinct(), "fact_id", "left_semi"))
        cited = met.select("fact_id", F.explode("event_ids").alias("episode_id"))
        return hops, P.lines(met, cited, at.read("episodes"), at.read("promotions"), edges, None if as_of_ms is None else F.lit(as_of_ms))

    def promote(self, dry_run: bool = True, at_ms: int | None = None) -> DataFrame:
        """The sweep's decisions on session facts and held candidates; unless it's a dry run, new versions and an audit row a decision are written at once.

        A fact that is disputed, or touches a CONFLICTS_WITH edge, is held until that is resolved.
        """
        said = F.concat_ws(" ", "subject", "predicate", "object_str", "raw_quote", "tags_text")
        scoped = F.lower(F.concat_ws(" ", "predicate", "object_str", "raw_quote", "tags_text")).rlike(L.REPO_WORDING)

        def decide(at: Snapshot) -> DataFrame:
            pool = self.current(at).filter("promotion_state IN ('session_only', 'workspace_candidate')")
            fights = at.read("edges").filter("edge_kind = 'CONFLICTS_WITH'")
            fights = fights.select(F.explode(F.array("from_id", "to_id")).alias("fact_id")).distinct().withColumn("__fights", F.lit(True))
            open_ = (F.col("status") == "disputed") | F.coalesce("__fights", F.lit(False))
            return pool.join(fights, "fact_id", "left").withColumn("decision", L.session_to_workspace(F.col, L.secret_bearing(F.col, X.contains_secret(said)), open_, scoped, F.lit(0)))

        if dry_run:
            return decide(self.tables.latest()).select("fact_id", "decision")
        made: list[DataFrame] = []

        def build(at: Snapshot) -> dict[str, DataFrame]:
            decided = materialise(decide(at))
            made[:] = [decided.select("fact_id", "decision")]
            up, held = F.col("decision").startswith("promote"), F.col("decision").startswith("candidate") & (F.col("promotion_state") == "session_only")
            to = F.when(up, "workspace_active").when(F.col("decision").startswith("candidate"), "workspace_candidate").otherwise(F.col("promotion_state"))
            when = F.coalesce(F.lit(at_ms).cast("bigint"), F.col("t_written"))
            audit = decided.select("fact_id", F.col("promotion_state").alias("from_state"), to.alias("to_state"), "decision", when.alias("created_at"))
            new = decided.filter(up | held).withColumns({"status": F.when(up, "active").otherwise("candidate"), "promotion_state": to, "version": F.col("version") + 1, "t_written": when})
            return {"facts": self._versions(new), "promotions": audit}

        self.tables.transact(build)
        return made[0]

    def resolve_conflict(self, session: str | None = None) -> DataFrame:
        """Per user, subject and predicate the winner by precedence and the runner-up among other values."""
        prec = S.precedence_rank(F.col("asserted_by"), F.col("trust_tier"), F.col("promotion_state"), F.col("tags_text"), F.col("session_id"), F.lit(session))
        rows = self.current().filter("status IN ('active', 'disputed')").withColumn("prec", prec).withColumn("object_hash", F.sha2("object_str", 256)).withColumn("key", T.content_key(F.col("subject"), F.col("predicate"), F.col("object_str")))
        return I.resolve_conflicts(rows.select("user_id", "subject", "predicate", "fact_id", "object_hash", "prec", "key"), ["user_id"]).filter("n_values > 1")

    def checkpoint_session(self, session: str) -> DataFrame:
        """A session's open loops and task states, and its last episodes' count."""
        facts = self.current().filter((F.col("session_id") == session) & F.col("fact_kind").isin("open_loop", "task_state") & (F.col("status") == "active"))
        return facts.select("fact_id", "fact_kind", "subject", "predicate", "object_str")
