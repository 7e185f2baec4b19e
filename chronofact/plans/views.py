"""Domain views over the supplied tables, as SQL that Spark and DuckDB both take.

`{name}` stands for a table; other braces are doubled. Times are epoch milliseconds. `facts` projects documents and labels onto the fact model; the
others give it episodes, prompts, commits, anchors, edges, injections and needs to work on.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Midnight of 2024-01-01, UTC.
EPOCH_MS = 1704067200000
#: The enumerations of the data model, in order.
FACT_KINDS = ("semantic", "episodic", "procedural", "preference", "decision", "constraint", "failure", "task_state", "open_loop")
PROMOTION_STATES = ("session_only", "workspace_candidate", "workspace_active", "user_dynamic_candidate", "user_dynamic_active", "user_static_candidate", "user_static_active")
ASSERTERS = ("user", "agent", "tool", "deterministic_parser", "llm_extractor", "git_watcher")
STATUSES = ("candidate", "active", "expired", "superseded", "disputed", "rejected")
#: What some queries ask, and some facts say.
SENTENCES = ("how do we install packages here", "which test suite to run tests with", "deploy the release", "database migration first", "login is auth", "format with biome please")
#: Queries of one word that no fact says, but that belongs to a concept some facts speak of.
PROBES = ("mocha", "prettier", "sqlite", "logout", "jest", "postgres")


def _case(number: str, values: tuple[str, ...]) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def text_id(prefix: str, number: str) -> str:
    return f"concat('{prefix}', cast({number} AS string))"


VIEWS: dict[str, str] = {
    "facts": f"""
SELECT concat('fact_', lpad(cast(d.doc_id AS string), 8, '0')) AS fact_id, d.doc_id AS seq, concat(d.source, '.', cast(cast((d.doc_id - d.doc_id % 1000) / 1000 AS bigint) AS string)) AS subject, {text_id("p", "d.doc_id % 7")} AS predicate, d.text AS object_str,
  {_case("d.doc_id % 9", FACT_KINDS)} AS fact_kind, CASE d.doc_id % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'dynamic' ELSE 'atemporal' END AS temporal_kind,
  {_case("d.doc_id * 7919 % 1009 % 10", ("active",) * 6 + ("candidate", "superseded", "disputed", "expired"))} AS status,
  {_case("d.doc_id % 7", PROMOTION_STATES)} AS promotion_state, CASE WHEN coalesce(l.quality, 1) = 1 AND d.doc_id % 8 <> 5 THEN 'high' ELSE 'low' END AS trust_tier,
  CASE WHEN d.doc_id % 50 = 3 THEN 'secret' ELSE 'public' END AS sensitivity, {_case("d.doc_id % 6", ASSERTERS)} AS asserted_by,
  cast(d.doc_id % 101 AS double) / 100 AS confidence, 1 + d.doc_id % 4 AS evidence_count, {EPOCH_MS} + d.doc_id * 60000 AS t_recorded,
  CASE WHEN d.doc_id * 7919 % 1009 % 10 = 9 THEN {EPOCH_MS} + d.doc_id * 60000 + 3600000 END AS t_expired,
  {text_id("u", "d.doc_id % 5")} AS user_id, CASE WHEN d.doc_id % 7 < 5 THEN {text_id("w", "d.doc_id % 3")} END AS workspace_id, CASE WHEN d.doc_id % 4 = 0 THEN {text_id("s", "d.doc_id % 11")} END AS session_id,
  CASE WHEN d.doc_id % 4 = 1 THEN substring(d.text, 1, 40) END AS raw_quote, d.lang AS lang, concat(d.lang, ' ', d.source) AS tags_text
FROM {{documents}} d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM {{labels}} GROUP BY doc_id) l ON d.doc_id = l.doc_id""",
    "commits": """
SELECT p_partkey AS commit_id, CASE WHEN p_partkey % 25 = 13 THEN p_partkey - 1 - p_partkey % 4 WHEN p_partkey > 1 THEN p_partkey - 1 END AS parent_id, CASE WHEN p_partkey % 25 = 20 THEN p_partkey - 8 END AS parent2_id,
  p_name AS message, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat('diff --git a/f b/f', chr(10), 'index ', cast(p_partkey AS string), '..', chr(10), '@@ -', cast(p_partkey AS string), ',2 +1,2 @@', chr(10), '-old ', cast(p_size AS string), chr(10), '+new   ', p_type) END AS diff, concat(cast(p_size AS string), p_type) AS change
FROM {part}""",
    "anchors": f"""
SELECT concat('fact_', lpad(cast(doc_id AS string), 8, '0')) AS fact_id, CASE WHEN doc_id % 13 = 0 THEN 'repo_b' ELSE 'repo_a' END AS repo_id, CASE WHEN doc_id % 2 = 0 THEN 'main' ELSE 'feat' END AS branch,
  1 + doc_id * 2 AS valid_from, CASE WHEN doc_id % 5 = 0 THEN 1 + (doc_id * 7) % 199 END AS valid_until, CASE WHEN doc_id % 3 = 0 THEN 1 + doc_id * 3 END AS introduced_by,
  {text_id("src/f", "doc_id % 40")} AS path_glob
FROM {{documents}} WHERE doc_id % 6 <> 1""",
    "episodes": """
SELECT event_id AS episode_id, concat('u', cast(user_id AS string), '_', substring(cast(ts AS string), 1, 10)) AS session_id,
  CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'view' THEN 'prompt_submitted' WHEN 'click' THEN 'tool_call' ELSE 'tool_result' END AS event_type,
  event_type <> 'error' AS success, user_id, ts AS created_at, value, props AS payload FROM {events}""",
    "prompts": """
SELECT concat('q', cast(conv_id AS string), '_', cast(turn AS string)) AS prompt_id, conv_id, turn, role, text FROM {conversations}""",
    "queries": """
SELECT item_id, text FROM {benchmark}""",
    "asks": f"""
SELECT item_id, CASE WHEN item_id % 3 = 0 THEN concat({_case("item_id % 18 / 3", SENTENCES)}, ' ', text) WHEN item_id % 9 = 1 THEN CASE item_id % 54 {" ".join(f"WHEN {1 + 9 * i} THEN '{w}'" for i, w in enumerate(PROBES))} END ELSE text END AS text FROM {{benchmark}}""",
    "edges": """
SELECT DISTINCT cast(l_partkey AS bigint) AS src, cast(l_suppkey AS bigint) AS dst FROM {lineitem}""",
    "fact_edges": """
SELECT l_orderkey * 8 + l_linenumber AS edge_id, concat('fact_', lpad(cast(l_partkey AS string), 8, '0')) AS from_id, concat('fact_', lpad(cast(l_suppkey AS string), 8, '0')) AS to_id,
  CASE l_linenumber % 6 WHEN 0 THEN 'SUPERSEDES' WHEN 1 THEN 'INVALIDATES' WHEN 2 THEN 'CONFLICTS_WITH' WHEN 3 THEN 'OVERRIDES' WHEN 4 THEN 'SUPPORTED_BY' ELSE 'SUPERSEDED_BY' END AS edge_kind,
  l_shipdate AS created_at FROM {lineitem}""",
    "files": """
SELECT doc_id, concat('repo', cast(cast((doc_id - doc_id % 12) / 12 AS bigint) AS string)) AS repo,
  CASE doc_id % 12 WHEN 0 THEN 'package.json' WHEN 1 THEN 'tsconfig.json' WHEN 2 THEN '.editorconfig' WHEN 3 THEN 'Dockerfile' WHEN 4 THEN '.github/workflows/ci.yml' WHEN 5 THEN 'AGENTS.md' WHEN 6 THEN 'src/gen.ts' WHEN 7 THEN '.nvmrc' WHEN 8 THEN 'pyproject.toml' WHEN 9 THEN CASE WHEN doc_id % 2 = 1 AND doc_id % 7 < 3 THEN 'yarn.lock' ELSE 'pnpm-lock.yaml' END WHEN 10 THEN 'vitest.config.ts' WHEN 11 THEN 'src/main.ts' END AS path,
  CASE doc_id % 12 WHEN 0 THEN concat('{{"name":"', source, '","type":"module","packageManager":"', CASE WHEN doc_id % 24 = 0 THEN 'pnpm@9' ELSE '' END, '","engines":{{"node":">=20"}},"scripts":{{"test":"vitest","build":"tsc","other":"x"}}}}') WHEN 1 THEN concat('{{ // options', chr(10), '"compilerOptions": {{"strict": true, "target": "es', cast(2015 + doc_id % 8 AS string), '", /* out */ "outDir": "dist",}}, "include": ["src", "test"]}}') WHEN 2 THEN concat('root = true', chr(10), '[*]', chr(10), 'indent_style = ', CASE WHEN doc_id % 5 = 0 THEN 'tab' ELSE 'space' END, chr(10), 'indent_size = ', cast(2 + doc_id % 3 AS string), chr(10), '[*.md]', chr(10), 'indent_style = tab') WHEN 3 THEN concat('FROM node:', cast(18 + doc_id % 5 AS string), ' AS build', chr(10), '# note', chr(10), 'WORKDIR /app', chr(10), 'EXPOSE 80 ', cast(3000 + doc_id % 10 AS string), chr(10), 'USER app') WHEN 4 THEN concat('steps:', chr(10), '  - run: npm test', chr(10), '  - run: |', chr(10), '      npm ci', chr(10), '      # note', chr(10), '      npm run ', source, chr(10), '  - run: "npm run lint"') WHEN 5 THEN concat('# Title', chr(10), '- always use `pnpm` in ', source, chr(10), 'plain words stand here', chr(10), '- never commit token=abcdefghijklmnop123') WHEN 6 THEN concat('// @generated from ', source, chr(10), text) WHEN 7 THEN concat('# pin', chr(10), 'v', cast(16 + doc_id % 8 AS string)) WHEN 8 THEN concat('[project]', chr(10), 'requires-python = ">=3.', cast(8 + doc_id % 5 AS string), '"', chr(10), '[project.scripts]', chr(10), 'run-it = "a:b"', chr(10), '[tool.poetry]', chr(10), '[tool.ruff]') WHEN 10 THEN concat('export default {{ test: {{ environment: "', CASE WHEN doc_id % 4 = 0 THEN 'node' ELSE 'jsdom' END, '", testTimeout: ', cast(1000 + doc_id % 9 AS string), ' }} }}') WHEN 11 THEN concat('export function handler', cast(doc_id % 30 AS string), '() {{ return handler', cast((doc_id * 7 + 3) % 30 AS string), '(); }}', chr(10), 'export class Store', cast(doc_id % 11 AS string), ' {{}}') ELSE '' END AS content FROM {documents}""",
    "trees": r"""
SELECT doc_id, concat('r', cast(doc_id - doc_id % 6 AS string)) AS repo,
  CASE doc_id % 6 WHEN 0 THEN '.github/workflows/ci.yml' WHEN 1 THEN 'tsconfig.json' WHEN 2 THEN 'docker-compose.yml' WHEN 3 THEN 'pyproject.toml' WHEN 4 THEN CASE doc_id % 4 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'poetry.lock' WHEN 2 THEN 'tox.ini' ELSE 'noxfile.py' END ELSE 'vitest.config.ts' END AS path,
  CASE doc_id % 6
  WHEN 0 THEN concat('jobs:', chr(10), '  build: # run: no', chr(10), '    steps:', chr(10), '      - name: all', chr(10), '        run: |', chr(10), '          ', replace(text, chr(10), concat(chr(10), '          ')), chr(10), '      - run: "make ', source, '"', chr(10), '      - run: >-', chr(10), '          # note', chr(10), '          last ', lang)
  WHEN 1 THEN concat('{{ // it''s "not" /* open', chr(10), '"extends": " ./base.', lang, '.json ", /* "include": [] */ "compilerOptions": {{"strict": ', CASE WHEN n_chars % 2 = 0 THEN 'true' ELSE 'false' END, ', "target": ["no"], "outDir": "//', source, '/*out*/",}}, "include": ["src/**/*.ts", "', source, '//x/**", "say \\"hi\\" /* ', lang, '", " ", 7,], "exclude": ["**/dist/**", "end\\\\"] // done', chr(10), '}}')
  WHEN 2 THEN concat('# services:', chr(10), 'services:', chr(10), '  ', source, ':', chr(10), '    image: "', lang, ':', cast(n_chars AS string), '" # "pinned"', chr(10), '    environment:', chr(10), '      NOTE: "a # b"', chr(10), '    ports:', chr(10), '      - "', cast(doc_id % 1000 AS string), ':80"', chr(10), '      - 443', chr(10), '  worker:', chr(10), '    build: ./', lang, chr(10), 'volumes:', chr(10), '  data:')
  WHEN 3 THEN concat('[project]', chr(10), 'requires-python = ">=3.', cast(8 + n_chars % 5 AS string), '"', chr(10), CASE WHEN n_chars % 3 = 0 THEN concat('[tool.uv.sources]', chr(10)) WHEN n_chars % 3 = 1 THEN concat('[tool.poetry]', chr(10)) ELSE '' END, '[dependency-groups]', chr(10), 'dev = ["', CASE WHEN lang = 'en' THEN 'PyTest>=8' ELSE 'pytest-cov' END, '", "pyright"]', chr(10), '[project.scripts]', chr(10), source, ' = "a.b:', lang, '"', chr(10), 'bad = 7', chr(10), '[build-system]', chr(10), 'build-backend = "', lang, '.build"')
  WHEN 4 THEN CASE doc_id % 4 WHEN 2 THEN CASE WHEN lang = 'en' THEN '[testenv:py]' ELSE '[tox]' END ELSE '@nox.session' END
  ELSE concat('export default {{ test: {{ environment: "', lang, '", testTimeout: ', cast(n_chars AS string), ', include: ["', source, '/**"], exclude: [], coverage: {{ provider: "v8", include: ["src/', lang, '"], exclude: ["', source, '", ''y''] }} }} }}') END AS content FROM {documents}""",
    "tool_files": """
SELECT doc_id, concat('repo', cast(doc_id AS string)) AS repo, CASE doc_id % 3 WHEN 0 THEN 'biome.json' WHEN 1 THEN '.eslintrc.json' ELSE '.prettierrc' END AS path, CASE doc_id % 3
  WHEN 0 THEN concat('{{"formatter":{{"lineWidth":', cast(80 + length(source) AS string), ',"indentStyle":"', CASE WHEN lang = 'en' THEN 'tab' ELSE 'space' END, '"}},"organizeImports":{{"enabled":true}},"linter":{{"rules":{{"recommended":true,"style":{{"noVar":"', lang, '","useConst":{{"level":"warn"}}}}}}}}}}')
  WHEN 1 THEN concat('{{"rules":{{"semi":["error","always"],"', source, '":"off"}}}}') ELSE concat('{{"printWidth":', cast(n_chars AS string), ',"tabWidth":2}}') END AS content FROM {documents}""",
    "injections": f"""
SELECT event_id AS injection_id, concat('u', cast(user_id AS string)) AS session_id, concat('fact_', lpad(cast(user_id % 150 AS string), 8, '0')) AS fact_a, concat('fact_', lpad(cast(event_id % 200 AS string), 8, '0')) AS fact_b,
  CASE event_type WHEN 'purchase' THEN 'helped' WHEN 'error' THEN 'harmful' WHEN 'view' THEN 'ignored' ELSE 'unknown' END AS outcome, {EPOCH_MS} + event_id * 60000 AS at_ms FROM {{events}}""",
}
_NEEDS = {name: sorted(set(re.findall(r"\{(\w+)\}", sql))) for name, sql in VIEWS.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name].strip(), **{t: table(spark, sf_dir, t) for t in _NEEDS[name]})


def duck(names: str, body: str) -> str:
    """DuckDB SQL: the named views as common table expressions before `body` (which may start with more of them)."""
    plain = lambda n: re.sub(r"[{](\w+)[}]", r"main.\1", VIEWS[n]).replace("{{", "{").replace("}}", "}").strip()
    ctes = ", ".join(f"{n} AS ({plain(n)})" for n in names.split())
    body = body.strip()
    if body[:5].upper() == "WITH ":
        body = body[5:]
        recursive = body[:10].upper() == "RECURSIVE "
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}, {body[10:] if recursive else body}"
    return f"WITH {ctes} {body}"
