"""Extraction from files that are long, broken or misleading."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from chronofact.functions import config as C
from chronofact.functions import secrets as X
from chronofact.operators import extract as E

FILES = "repo string, path string, content string"


def said(spark, extractor, rows):
    got = extractor(spark.createDataFrame(rows, FILES)).select("repo", "predicate", "object").collect()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize("text", [
    '{"a": "src/**/*.ts", "b": "http://x//y", /* "a": 1 */ "c": [1, 2,], // "d": "e"\n}', '{"a": "q\\"//\\\\", "b": "/* in */", }', '{"a": "\\\\\\"/*"}', '{"a": 1} /* open', '{"a": "' + "\\\\" * 60_000 + '"} // end', '{"a": ", ]"}', "{}",
])
def test_jsonc_keeps_strings(spark, text):
    out, i, end = [], 0, len(text)  # a scan by hand
    while i < end:
        if text[i] == '"':
            j = i + 1
            while text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else end
        elif text.startswith("/*", i):
            i = text.find("*/", i) + 2 if "*/" in text[i:] else end
        elif text[i] == "," and text[i + 1 :].lstrip()[:1] in ("}", "]") or text[i] == "," and '//' in text[i + 1 : i + 4]:
            i += 1
        else:
            out.append(text[i])
            i += 1
    got = spark.createDataFrame([(text,)], "t string").select(C.jsonc(F.col("t")).alias("t")).first()["t"]
    assert json.loads(got) == json.loads("".join(out))


def test_tsconfig(spark):
    text = '{ /* x */ "extends": "a/b", "compilerOptions": {"strict": true, "target": ["x"], "outDir": null, "module": "esnext", "rootDir": {}}, "include": ["src/**/*.ts", "a//b", 3], "exclude": [], // no\n }'
    want = [("r", "typescript_extends_config", "a/b"), ("r", "typescript_include_globs", '["src/**/*.ts","a//b"]'), ("r", "typescript_module", "esnext"), ("r", "typescript_strict_mode", "true")]
    assert said(spark, E.tsconfig, [("r", "tsconfig.json", text), ("s", "tsconfig.json", "{broken"), ("t", "tsconfig.json", None), ("u", "tsconfig.json", "[1]")]) == want


def test_long_blocks(spark):
    lines = "".join(f"          step {i}\n" for i in range(100_000))
    text = "jobs:\n  a:\n    steps:\n      - run: |\n" + lines + "      - run: 'last one'\n"
    assert len(E.run_steps(text)) == 100_001
    assert said(spark, E.ci_commands, [("r", ".github/workflows/a.yml", text)]) == sorted(("r", "ci_command", f"step {i}") for i in range(10))
    odd = "on: push\njobs:\n  b:\n    steps:\n    - name: run\n      run: npm test # all\n    - run: >\n        # note\n        a b\n\n        c: d\n    - run: |\n    - uses: x\n    - run: \"q\"\n      env:\n        run_it: no\n" + "    - run: " + "y" * 300 + "\n"
    assert [x for _, x in E.run_steps(odd)] == ["npm test # all", "a b", "c: d", "q"]
    assert E.run_steps("") == [] and E.run_steps("run:\n\trun: z") == [("ci_command", "z")]


def test_dockerfile(spark):
    flags = "FROM " + "--platform=x " * 20_000 + "node:20 AS build\nEXPOSE 80 443/udp\nuser app # who\nFROM build as final\nfrom scratch\n"
    want = [("container_base_image", "build"), ("container_base_image", "node:20"), ("container_base_image", "scratch"), ("container_exposed_port", "443/udp"), ("container_exposed_port", "80"), ("container_stage_base", "build=node:20"), ("container_stage_base", "final=build"), ("container_user", "app")]
    assert [x[1:] for x in said(spark, E.dockerfile, [("r", "Dockerfile", flags), ("r", "src/Dockerfile", flags)])] == want
    assert len(said(spark, E.dockerfile, [("r", "Dockerfile.dev", "WORKDIR /a\n" * 500)])) == 60


def test_compose():
    text = "version: '3'\nservices:\n  web.app:\n    image: 'a#b:1' # c\n    build:\n      context: ./x\n    ports: # p\n      - \"8080:80\"\n      - 443 # s\n    depends_on:\n      - db\n  db:\n    build: \"./db\"\n    environment:\n      image_name: no\nnetworks:\n  image: none\n"
    assert E.compose_services(text) == [("compose_service", "web.app"), ("compose_image", "web.app=a#b:1"), ("compose_port", "web.app=8080:80"), ("compose_port", "web.app=443"), ("compose_service", "db"), ("compose_build_context", "db=./db")]
    assert len(E.compose_services("services:\n" + "".join(f"  s{i}:\n    image: x\n" for i in range(50_000)))) == 60
    assert E.compose_services("services:\n") == [] and E.compose_services("\t- : -\n" * 10) == []


def test_python_files(spark):
    rows = [
        ("a", "pyproject.toml", '[tool.poetry]\nname = "x"\n[dependency-groups]\ndev = ["mypy"]\n\n[project.scripts]\nrun-it = "m:f"\nbad\n[next]\nno = "m:g"\n'), ("a", "uv.lock", ""), ("b", "pyproject.toml", "[tool.poetry.x]\n[tool.pytest.ini_options]\n[tool.mypyx]"),
        ("c", "requirements.txt", "x"), ("c", "poetry.lock", ""), ("d", "tox.ini", "[testenv]\n"), ("d", "noxfile.py", "import nox\n@nox.session\ndef t(s): pass"), ("e", "tox.ini", "[tox]"), ("f", "pyproject.toml", None),
    ]
    want = [
        ("a", "cli_entrypoint", "run-it -> m:f"), ("a", "package_manager", "uv"), ("a", "typecheck_command", "mypy ."), ("b", "package_manager", "poetry"), ("b", "test_command", "pytest"),
        ("c", "package_manager", "poetry"), ("d", "test_command", "nox"), ("d", "test_command", "tox"),
    ]
    assert said(spark, E.pyproject, rows) == want


def test_globs_of_tests(spark):
    text = "test: { environment: 'node', include: ['a/**', \"b\"], exclude: [ ], coverage: { include: ['c'],\n exclude: ['d',\n'e'] } }"
    want = [("r", "coverage_exclude_globs", '["d","e"]'), ("r", "coverage_include_globs", '["c"]'), ("r", "test_environment", "node"), ("r", "test_include_globs", '["a/**","b"]'), ("r", "test_runner", "vitest")]
    assert said(spark, E.test_config, [("r", "vitest.config.ts", text), ("s", "README.md", text)]) == want


def test_secret_patterns_end(spark):
    header = "-----BEGIN " + "RSA " * 20_000 + "PRIVATE KEY-----"
    rows = [(header, False), ("x -----BEGIN RSA PRIVATE KEY----- y", True), ("-----BEGIN PRIVATE KEY-----", True), ("-----BEGIN PGP PRIVATE KEY BLOCK-----", True), ("-----BEGIN FOOPRIVATE KEY-----", False)]
    got = spark.createDataFrame(rows, "t string, want boolean").select(X.contains_secret(F.col("t")).alias("got"), "want", X.redact(F.col("t")).alias("r")).collect()
    assert all(r["got"] == r["want"] == ("[REDACTED:private_key]" in r["r"]) for r in got)
