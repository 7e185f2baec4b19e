"""Extraction of facts from file rows (path, content)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.functions import config as C
from chronofact.functions.secrets import contains_secret
from chronofact.operators.facts import top_per
from chronofact.shipping import ship

#: What makes a line of prose guidance.
GUIDANCE = r"(?i)\b(use|run|do not|don't|never|always|prefer|must|should|convention|note)\b"


def claims(text: Column) -> Column:
    """Lines of guidance, bullets and backticks taken off, once each, in order."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda t: F.trim(t)), lambda t: (t != "") & ~t.startswith("#") & ~t.startswith("```"))
    bare = F.transform(lines, lambda t: F.regexp_replace(t, r"^[-*+]\s+", ""))
    kept = F.filter(bare, lambda t: F.length(t).between(12, 240) & t.rlike(GUIDANCE))
    return F.array_distinct(F.transform(kept, lambda t: F.replace(t, F.lit("`"), F.lit(""))))


#: What scripts, lockfiles, options and markers mean.
SCRIPTS = {"test": "test_command", "build": "build_command", "dev": "dev_command", "start": "start_command", "lint": "lint_command", "typecheck": "typecheck_command", "format": "format_command"}
LOCKFILES = (("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("bun.lockb", "bun"), ("bun.lock", "bun"), ("package-lock.json", "npm"))
COMPILER_OPTIONS = {
    "strict": "typescript_strict_mode", "noUncheckedIndexedAccess": "typescript_no_unchecked_indexed_access", "noImplicitOverride": "typescript_no_implicit_override",
    "noFallthroughCasesInSwitch": "typescript_no_fallthrough_cases", "target": "typescript_target", "module": "typescript_module", "moduleResolution": "typescript_module_resolution",
    "rootDir": "typescript_source_root", "outDir": "typescript_output_dir", "declaration": "typescript_declaration_output",
}
GENERATED = ("@generated", "DO NOT EDIT", "Code generated by", "autogenerated", "This file is auto-generated")
PYTHON_LOCKFILES = (("uv.lock", "uv"), ("poetry.lock", "poetry"), ("requirements.txt", "pip"))
DOCKERFILES = ("Dockerfile", "Dockerfile.dev", "docker/Dockerfile")
COMPOSE_FILES = ("compose.yaml", "compose.yml", "docker-compose.yaml", "docker-compose.yml")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def _said(files: DataFrame, pairs: Column) -> DataFrame:
    """files with an array of (predicate, object), as rows (repo, path, predicate, object); nulls and blanks say nothing."""
    out = files.select("repo", "path", F.explode(pairs).alias("p")).select("repo", "path", "p.predicate", "p.object")
    return out.filter("predicate IS NOT NULL AND object IS NOT NULL AND object <> ''")


def _pair(predicate: str | Column, obj: Column) -> Column:
    return F.struct((F.lit(predicate) if isinstance(predicate, str) else predicate).alias("predicate"), obj.cast("string").alias("object"))


def _lines(text: Column, comment: str = r"#.*$") -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, comment, ""))), lambda x: x != "")


def package_json(files: DataFrame) -> DataFrame:
    """Scripts and metadata of package.json; scripts run by the declared manager, else the lockfile's, else npm."""
    schema = "name string, type string, packageManager string, engines struct<node:string>, bin map<string,string>, workspaces array<string>, scripts map<string,string>"
    own = files.filter("path = 'package.json'").withColumn("j", F.from_json("content", schema)).filter("j IS NOT NULL")
    declared = F.element_at(F.split("j.packageManager", "@"), 1)
    own = own.join(lockfile(files).select("repo", F.col("object").alias("locked")), "repo", "left")
    runner = F.coalesce(F.when(declared.isin("npm", "pnpm", "yarn", "bun"), declared), F.col("locked"), F.lit("npm"))
    scripts = F.transform(F.map_keys(F.coalesce("j.scripts", F.create_map().cast("map<string,string>"))), lambda k: _pair(_map(SCRIPTS)[k], F.concat(runner, F.lit(" run "), k)))
    meta = F.array(
        _pair("package_name", F.trim("j.name")), _pair("node_module_type", F.trim("j.type")), _pair("node_engine", F.col("j.engines.node")), _pair("declared_package_manager", F.col("j.packageManager")))
    bins = F.transform(F.slice(F.map_keys(F.coalesce("j.bin", F.create_map().cast("map<string,string>"))), 1, 20), lambda k: _pair("cli_bin", k))
    spaces = F.transform(F.slice(F.coalesce("j.workspaces", F.array().cast("array<string>")), 1, 50), lambda w: _pair("workspace_globs", w))
    return _said(own, F.concat(scripts, meta, bins, spaces))


def lockfile(files: DataFrame) -> DataFrame:
    """The package manager by the first of the lockfiles that a repository has."""
    order = F.array_position(F.array(*[F.lit(f) for f, _ in LOCKFILES]), F.col("path"))
    found = files.filter(F.col("path").isin(*[f for f, _ in LOCKFILES])).groupBy("repo").agg(F.min_by("path", order).alias("path"))
    return found.select("repo", "path", F.lit("package_manager").alias("predicate"), _map(dict(LOCKFILES))[F.col("path")].alias("object"))


def tsconfig(files: DataFrame) -> DataFrame:
    """Compiler options, include and exclude globs as arrays, the configuration that it extends; comments and trailing commas are allowed."""
    own = files.filter("path = 'tsconfig.json'").withColumn("j", C.jsonc(F.col("content"))).filter(F.try_parse_json("j").isNotNull())
    j = F.col("j")
    options = F.array(*[_pair(p, C.scalar(j, f"$.compilerOptions.{o}")) for o, p in COMPILER_OPTIONS.items()])
    globs = F.array(_pair("typescript_include_globs", F.to_json(C.strings(j, "$.include"))), _pair("typescript_exclude_globs", F.to_json(C.strings(j, "$.exclude"))))
    return _said(own, F.concat(options, globs, F.array(_pair("typescript_extends_config", F.trim(C.scalar(j, "$.extends"))))))


def editorconfig(files: DataFrame) -> DataFrame:
    """Indentation of the [*] section."""
    section = F.regexp_extract("content", r"(?s)(?:^|\n)\s*\[\*\]\s*\n(.*?)(?:\n\s*\[|$)", 1)
    get = lambda k: F.trim(F.regexp_extract(section, rf"(?m)^\s*{k}\s*=\s*(.*)$", 1))
    style, size = get("indent_style"), get("indent_size")
    return _said(files.filter("path = '.editorconfig'"), F.array(_pair("indent_style", F.when(size != "", F.concat(style, F.lit(" (size "), size, F.lit(")"))).otherwise(style))))


def dockerfile(files: DataFrame, most: int = 60) -> DataFrame:
    """Base images, stages, ports, workdirs and users, line by line, the first `most` of a file."""

    def pairs(x: Column) -> Column:
        words = F.split(x, r"\s+")
        rest = F.filter(F.slice(words, 2, 1_000_000), lambda w: ~w.startswith("--"))
        image = F.when(F.upper(words[0]) == "FROM", F.get(rest, F.lit(0)))
        stage = F.get(rest, F.nullif(F.array_position(F.transform(rest, lambda w: F.upper(w)), "AS"), F.lit(0)).cast("int"))
        line = lambda p: F.regexp_extract(x, p, 1)
        ports = F.transform(F.slice(F.split(line(r"(?i)^EXPOSE\s+(.+)$"), r"\s+"), 1, 20), lambda p: _pair("container_exposed_port", p))
        return F.concat(F.array(_pair("container_base_image", image), _pair("container_stage_base", F.when(stage.isNotNull(), F.concat(stage, F.lit("="), image)))), ports, F.array(_pair("container_workdir", line(r"(?i)^WORKDIR\s+(.+)$")), _pair("container_user", line(r"(?i)^USER\s+(.+)$"))))

    rows = files.filter(F.col("path").isin(*DOCKERFILES))
    said = F.filter(F.flatten(F.transform(_lines(F.col("content")), pairs)), lambda p: p["object"].isNotNull() & (p["object"] != ""))
    return _said(rows, F.slice(said, 1, most))


def _by_file(files: DataFrame, read: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """(repo, path, pos, predicate, object) of what `read` finds in each file's content."""
    ship(files.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(repo, path, i, *pair) for repo, path, content in zip(part["repo"], part["path"], part["content"], strict=True) for i, pair in enumerate(read(content or ""))]
            yield pd.DataFrame(rows, columns=["repo", "path", "pos", "predicate", "object"])

    return files.select("repo", "path", "content").mapInPandas(run, "repo string, path string, pos int, predicate string, object string")


def compose_services(text: str, services: int = 30, ports: int = 20, most: int = 80) -> list[tuple[str, str]]:
    """Services of a compose file with their images, build contexts and ports, as predicates and objects; the first of each."""
    found: dict[str, dict[str, list[str]]] = {}
    for above, key, value in C.indented(text):
        if above == ["services"] and not value and key not in ("-", "|"):
            found.setdefault(key, {"image": [], "build": [], "ports": []})
        elif above[:1] == ["services"] and len(above) > 1 and (own := found.get(above[1])) is not None:
            if key in ("image", "build") and value:
                own[key] = [C.unquoted(value)]
            elif key == "-" and above[-1] == "ports":
                own["ports"].append(C.unquoted(value))
    out = []
    for name, own in list(found.items())[:services]:
        out.append(("compose_service", name))
        for key, predicate in (("image", "compose_image"), ("build", "compose_build_context"), ("ports", "compose_port")):
            out += [(predicate, f"{name}={x}") for x in own[key][:ports] if x]
    return out[:most]


def compose(files: DataFrame) -> DataFrame:
    """Services, images, build contexts and ports of compose files; what is said of a service begins with its name."""
    return _by_file(files.filter(F.col("path").isin(*COMPOSE_FILES)), compose_services).drop("pos")


def runtime_versions(files: DataFrame) -> DataFrame:
    """Version pins of .nvmrc, .node-version, .python-version and .tool-versions."""
    first = F.get(_lines(F.col("content")), F.lit(0))
    one = F.when(F.length(first) <= 80, F.concat(F.when(F.col("path") == ".python-version", "python ").otherwise("node "), first))
    many = F.transform(F.slice(_lines(F.col("content")), 1, 40), lambda x: _pair("version_pin", F.regexp_replace(x, r"\s+", " ")))
    own = files.filter("path IN ('.nvmrc', '.node-version', '.python-version', '.tool-versions')")
    return _said(own, F.when(F.col("path") == ".tool-versions", many).otherwise(F.array(_pair("version_pin", one))))


def python_manager(files: DataFrame) -> DataFrame:
    """The manager by the first of the lock files that a repository has, else by the tool sections of its pyproject.toml."""
    tool = lambda name: F.col("content").rlike(rf"(?m)^\s*\[tool\.{name}(?:\.[^\]]+)?\]\s*$")
    held = F.when(F.col("path") == "pyproject.toml", F.when(tool("uv"), "uv").when(tool("poetry"), "poetry")).otherwise(_map(dict(PYTHON_LOCKFILES))[F.col("path")])
    order = F.array_position(F.array(*[F.lit(f) for f, _ in PYTHON_LOCKFILES], F.lit("pyproject.toml")), F.col("path"))
    own = files.filter(F.col("path").isin(*dict(PYTHON_LOCKFILES), "pyproject.toml")).select("repo", "path", held.alias("object"), order.alias("order")).filter("object IS NOT NULL")
    found = own.groupBy("repo").agg(F.min_by(F.struct("path", "object"), "order").alias("f"))
    return found.select("repo", "f.path", F.lit("package_manager").alias("predicate"), "f.object")


def pyproject(files: DataFrame) -> DataFrame:
    """Python's manager, build backend, version constraint, commands of configured or depended-on tools, script entry points, tox and nox."""
    c = F.col("content")
    tool = lambda name: c.rlike(rf"(?m)^\s*\[tool\.{name}(?:\.[^\]]+)?\]\s*$")
    get = lambda k: F.trim(F.regexp_extract(c, rf"""(?m)^\s*{k}\s*=\s*["']([^"']+)["']""", 1))
    none = F.array().cast("array<string>")
    wanted = F.lower(F.array_join(F.concat(F.coalesce(C.section(c, "dependency-groups"), none), F.coalesce(C.section(c, "project.optional-dependencies"), none)), "\n"))
    has = lambda name: tool(name) | wanted.rlike(rf"(?:^|[^a-z0-9_-]){name}(?:[^a-z0-9_-]|$)")
    scripts = F.filter(F.transform(F.coalesce(C.section(c, "project.scripts"), none), lambda x: F.regexp_replace(x, r"""^\s*([A-Za-z0-9_.-]+)\s*=\s*["']([^"']+)["']\s*$""", "$1 -> $2")), lambda x: x.rlike(r"^[A-Za-z0-9_.-]+ -> [^\"']+$"))
    names = F.transform(F.slice(scripts, 1, 12), lambda x: _pair("cli_entrypoint", x))
    given = F.array(
        _pair("build_backend", get("build-backend")), _pair("version_constraint", get("requires-python")), _pair("test_command", F.when(has("pytest"), "pytest")),
        _pair("lint_command", F.when(has("ruff"), "ruff check .")), _pair("typecheck_command", F.when(has("mypy"), "mypy .").when(has("pyright"), "pyright")),
    )
    out = _said(files.filter("path = 'pyproject.toml'"), F.concat(given, names))
    tox = (F.col("path") == "tox.ini") & c.rlike(r"(?m)^\s*\[testenv(?::[^\]]+)?\]\s*$")
    nox = (F.col("path") == "noxfile.py") & c.rlike(r"@nox\.session\b")
    harness = _said(files.filter("path IN ('tox.ini', 'noxfile.py')"), F.array(_pair("test_command", F.when(tox, "tox").when(nox, "nox"))))
    return out.unionByName(python_manager(files)).unionByName(harness)


def test_config(files: DataFrame, most: int = 30) -> DataFrame:
    """Runner by file name; of vitest the environment, timeout, coverage provider and the globs that tests and, after the word coverage, its report include and exclude."""
    name = F.regexp_extract("path", r"^(vitest|jest|playwright|cypress)\.config\.", 1)
    own = files.filter("path RLIKE '^(vitest|jest|playwright|cypress)[.]config[.]'")
    c, vitest = F.col("content"), name == "vitest"
    text = lambda k: F.when(vitest, F.trim(F.regexp_extract(c, rf"""\b{k}\s*:\s*["']([^"']+)["']""", 1)))
    whole = F.instr(c, "coverage") - 1

    def globs(key: str) -> Column:
        """Arrays assigned to the key, by place: the text is cut where one begins, so a piece's length tells where the next is."""
        pieces = F.split(c, rf"\b(?={key}\s*:\s*\[)", -1)
        at = F.transform(pieces, lambda p, i: F.struct(F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda n, x: n + F.length(x)).alias("at"), F.regexp_extract(p, rf"^{key}\s*:\s*\[([^\]]*+)\]", 1).alias("body")))
        quoted = lambda body: F.filter(F.regexp_extract_all(body, F.lit(r"""["']([^"']+)["']"""), F.lit(1)), lambda x: F.trim(x) != "")
        said = F.transform(at, lambda p: _pair(F.when((whole >= 0) & (p["at"] > whole), f"coverage_{key}_globs").otherwise(f"test_{key}_globs"), F.when(F.size(quoted(p["body"])) > 0, F.to_json(quoted(p["body"])))))
        return F.when(vitest, said).otherwise(F.array().cast("array<struct<predicate:string,object:string>>"))

    number = F.when(vitest, F.regexp_extract(c, r"\btestTimeout\s*:\s*(\d+)", 1))
    said = F.concat(F.array(_pair("test_runner", name), _pair("test_environment", text("environment")), _pair("test_timeout_ms", number), _pair("coverage_provider", text("provider"))), globs("include"), globs("exclude"))
    return _said(own, F.slice(F.filter(said, lambda p: p["object"].isNotNull() & (p["object"] != "")), 1, most))


def tooling(files: DataFrame, most: int = 20) -> DataFrame:
    """Formatters and linters by the configuration files that stand there, with formatting widths, import order and the first `most` rules of a linter with their levels."""
    name = F.regexp_extract("path", r"^(?:\.?)(biome|eslint|prettier)", 1)
    own = files.filter("path RLIKE '^[.]?(biome[.]json|eslint|prettier)'").withColumn("n", name)
    kind = F.when(F.col("n") == "biome", "code_quality_tool").when(F.col("n") == "eslint", "lint_tool").otherwise("format_tool")
    get = lambda path: F.get_json_object("content", path)
    given = F.array(
        _pair(kind, F.col("n")), _pair("formatter_line_width", F.coalesce(get("$.formatter.lineWidth"), get("$.printWidth"))), _pair("formatter_indent_style", get("$.formatter.indentStyle")),
        _pair("formatter_indent_width", F.coalesce(get("$.formatter.indentWidth"), get("$.tabWidth"))), _pair("organize_imports", get("$.organizeImports.enabled")),
    )
    # Rules as name: level or name: [level, ...], those of biome by group.
    none = F.create_map().cast("map<string,string>")
    level = lambda v: F.coalesce(F.get_json_object(v, "$[0]"), F.get_json_object(v, "$.level"), v)
    rules = lambda entries, under: F.transform(entries, lambda e: _pair("linter_rule_level", F.concat(under, e["key"], F.lit("="), level(e["value"]))))
    flat = rules(F.map_entries(F.coalesce(F.from_json(get("$.rules"), "map<string,string>"), none)), F.lit(""))
    groups = F.map_entries(F.coalesce(F.from_json(get("$.linter.rules"), "map<string,string>"), none))
    deep = F.flatten(F.transform(groups, lambda g: F.when(g["value"].startswith("{"), rules(F.map_entries(F.coalesce(F.from_json(g["value"], "map<string,string>"), none)), F.concat(g["key"], F.lit(".")))).otherwise(F.array(_pair("linter_rule_level", F.concat(g["key"], F.lit("="), g["value"]))))))
    return _said(own, F.concat(given, F.slice(F.array_sort(F.concat(flat, deep)), 1, most)))


def generated_markers(files: DataFrame, most: int = 20) -> DataFrame:
    """Files that say within their first 600 characters that they are generated; the first `most` of a repository by path."""
    head = F.substring("content", 1, 600)
    marked = F.lit(False)
    for m in GENERATED:
        marked = marked | F.contains(head, F.lit(m))
    own = files.filter((F.length("content") < 200_000) & ~F.col("path").rlike(r"(^|/)(node_modules|\.git|dist|build|coverage)/") & marked)
    return top_per(own, ["repo"], [F.col("path")], most).select("repo", "path", F.lit("do_not_edit").alias("predicate"), F.lit("true").alias("object"))


def run_steps(text: str) -> list[tuple[str, str]]:
    """The commands of a workflow's `run:` entries, inline or lines of a block, comments left out, those under 200 characters."""
    out = []
    for above, key, value in C.indented(text, comments=False):
        said = C.unquoted(value) if key == "run" and value[:1] not in ("", "|", ">") else value if key == "|" and above and above[-1] == "run" and not value.startswith("#") else ""
        if 0 < len(said) < 200:
            out.append(("ci_command", said))
    return list(dict.fromkeys(out))


def ci_commands(files: DataFrame, most: int = 10) -> DataFrame:
    """`run:` steps of workflows, once each, the first `most` of a repository by file and place."""
    rows = _by_file(files.filter(r"path RLIKE '^[.]github/workflows/[^/]*[.]ya?ml$'"), run_steps)
    first = rows.groupBy("repo", "object").agg(F.min(F.struct("path", "pos")).alias("at"))
    return top_per(first, ["repo"], [F.col("at")], most).select("repo", F.col("at.path").alias("path"), F.lit("ci_command").alias("predicate"), "object")


def guidance(files: DataFrame, most: int = 8) -> DataFrame:
    """Claims of AGENTS.md, CLAUDE.md and README.md, low in trust, those with secrets dropped."""
    own = files.filter("path IN ('AGENTS.md', 'CLAUDE.md', 'README.md')")
    rows = own.select("repo", "path", F.explode(F.slice(claims(F.col("content")), 1, most)).alias("object"))
    return rows.filter(~contains_secret(F.col("object"))).select("repo", "path", F.lit("claims").alias("predicate"), "object")


EXTRACTORS = {
    "package_json": package_json, "lockfile": lockfile, "tsconfig": tsconfig, "editorconfig": editorconfig, "dockerfile": dockerfile, "compose": compose, "runtime_versions": runtime_versions,
    "pyproject": pyproject, "test_config": test_config, "tooling": tooling, "generated_markers": generated_markers, "ci_commands": ci_commands, "guidance": guidance,
}


def extract_all(files: DataFrame, names: tuple[str, ...] = tuple(EXTRACTORS)) -> DataFrame:
    """All extractors' facts, those with secrets dropped; a repository's files meet only in the ones that need it."""
    out = None
    for name in names:
        part = EXTRACTORS[name](files).withColumn("extractor", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.filter(~contains_secret(F.concat_ws(" ", "predicate", "object")))
