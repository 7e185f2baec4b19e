"""Secret scanning with an incremental ledger of blobs.

Every version of a text is a blob, addressed by its SHA-256. The ledger lists the (blob, rule version) pairs already scanned with
their findings. Blobs' hashes are held against it first; one row of each unseen blob is then found again where its text lies, by a filter of
those rows, and scanned; no pattern is run over any other text, so a second run scans nothing. The ledger's findings are joined back to all documents. The ledger is a Parquet folder that grows by appends; a run that is lost half
way leaves pairs unseen and they are scanned the next time.

Beside the base kinds (assign, access, hex) the rules find private-key headers, provider tokens and JSON web tokens.

Defined results: a null text is empty; repeated rows and copies get the same findings; findings of the same place and kind
appear once; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.llm.common import BitFilter, id_of, join_by_key, materialise, shared_folder, text_of
from chronofact.llm.spans import Kind, find, listed, replaced, summary

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
BASE = 3
RULES_VERSION = "1"


def rules() -> list[Kind]:
    """The base kinds, as listed, then the others. Possessive and bounded forms of the same patterns, so that long runs cost no backtracking."""
    m, t = F.col("__m"), F.col("__t")
    always = F.lit(True)
    return [
        Kind("assign", ASSIGN, F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, t.rlike(r"(?i:passw|secret|token|api_?key)")),
        Kind("access", r"AKIA[A-Z0-9]{16,}+", always, t.contains("AKIA")),
        Kind("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", always, t.rlike(r"[0-9a-f]{24}")),
        Kind("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", always, t.contains("-----BEGIN ")),
        Kind("provider_token", r"(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|AIza[A-Za-z0-9_-]{35})", always, t.rlike(r"gh[pousr]_|xox[abprs]-|sk-|AIza")),
        Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", always, t.contains("eyJ")),
    ]


def empty_ledger(spark: SparkSession) -> str:
    """A new ledger folder in the shared folder."""
    return f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = "blob string, rules string, findings array<struct<start: bigint, rank: int, end: bigint, kind: string>>"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def paths_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, __id and the blob of every row."""
    return materialise(docs.select(F.col(id_col).alias("doc_id"), id_of(id_col).alias("__id"), F.sha2(text_of(text_col), 256).alias("blob")))


def scan_unseen(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", version: str = RULES_VERSION, paths: DataFrame | None = None) -> None:
    """Scan the blobs that the ledger lacks under this rule version and append them, with findings or without.

    Texts that cannot have findings, by literal hints, enter the ledger by hash alone; only texts with hints move.
    """
    spark = docs.sparkSession
    paths = paths_of(docs, id_col, text_col) if paths is None else paths
    seen = _ledger(spark, ledger).filter(F.col("rules") == version).select("blob")
    unseen = materialise(paths.groupBy("blob").agg(F.min("__id").alias("__id")).join(seen, "blob", "left_anti"))
    if not unseen.take(1):
        return
    row = F.xxhash64("blob", "__id")
    rows = docs.select(id_of(id_col).alias("__id"), text_of(text_col).alias("__t")).withColumn("blob", F.sha2("__t", 256))
    rows = BitFilter.of(unseen, row, unseen.count()).mark(rows, row, "__maybe").filter("__maybe")
    kinds = rules()
    hints = kinds[0].hint
    for kind in kinds[1:]:
        hints = hints | kind.hint
    texts = materialise(rows.filter(hints).join(unseen, ["blob", "__id"], "left_semi").select("blob", "__t").dropDuplicates(["blob"]))
    spans = find(texts, ["blob"], "__t", kinds)
    found = summary(spans, ["blob"], BASE).select("blob", F.array_sort("all").alias("findings"))
    unseen.select("blob").join(found, "blob", "left").select("blob", F.lit(version).alias("rules"), "findings").write.mode("append").parquet(ledger)


def scan(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", version: str = RULES_VERSION) -> DataFrame:
    """Per document: doc_id, blob, findings (all spans), base (those of the base kinds)."""
    spark = docs.sparkSession
    ledger = ledger or empty_ledger(spark)
    paths = paths_of(docs, id_col, text_col)
    scan_unseen(docs, ledger, id_col, text_col, version, paths)
    found = _ledger(spark, ledger).filter((F.col("rules") == version) & (F.size("findings") > 0)).dropDuplicates(["blob"]).select("blob", "findings")
    found = materialise(paths.groupBy("blob").agg(F.count(F.lit(1)).alias("__n")).join(found, "blob"))
    out = join_by_key(paths, found, ["blob"], "__n", paths.count(), F.col("doc_id")).drop("__n")
    none = F.expr("cast(array() as array<struct<start: bigint, rank: int, end: bigint, kind: string>>)")
    out = out.withColumn("findings", F.coalesce("findings", none))
    return out.select("doc_id", "blob", "findings", F.filter("findings", lambda s: s["rank"] < BASE).alias("base"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """doc_id, text: each finding replaced by [KIND]."""
    found = scan(docs, id_col=id_col, text_col=text_col, **options).filter(F.size("findings") > 0).groupBy("blob").agg(F.first("findings").alias("findings"))
    found = found.select("blob", F.explode("findings").alias("s"))
    found = found.select("blob", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.concat(F.lit("["), F.upper("s.kind"), F.lit("]")).alias("by"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("__t")).withColumn("blob", F.sha2("__t", 256))
    return replaced(rows, ["blob"], "__t", found, "text").select("doc_id", "text")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    count = lambda name: F.size(F.filter("base", lambda s: s["kind"] == name)).cast("bigint").alias(f"n_{name}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))
