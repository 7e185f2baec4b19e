"""Sources and sinks: JSON lines, file trees, versioned tables with upgrades, hook output, capsules in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schema upgrades in order: (version, columns that it adds with their defaults). Forward only.
UPGRADES: tuple[tuple[int, dict[str, str]], ...] = (
    (2, {"promotion_state": "'session_only'"}),
    (3, {"trust_tier": "'low'"}),
    (4, {"t_observed": "t_recorded"}),
)
SKIPPED = r"(^|/)(node_modules|\.git|dist|build|coverage)/"


def append_jsonl(df: DataFrame, folder: str) -> None:
    """Append as JSON lines."""
    df.write.mode("append").json(folder)


def read_jsonl(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Read JSON lines; rows that don't parse are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder)
    return rows.filter("_bad IS NULL").drop("_bad")


def read_tree(spark: SparkSession, folder: str, most_bytes: int = 200_000) -> DataFrame:
    """(path, content) of the text files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(F.col("length") < most_bytes)
    rel = F.regexp_replace(F.col("path"), r"^\w+:/*", "/")
    return files.select(rel.alias("path"), F.decode("content", "UTF-8").alias("content")).filter(~F.col("path").rlike(SKIPPED))


def upgrade(df: DataFrame, version: int, to: int | None = None) -> DataFrame:
    """Add what later versions brought; a table newer than all upgrades is an error."""
    newest = UPGRADES[-1][0]
    if version > newest:
        raise ValueError(f"table version {version} is newer than {newest}")
    for number, columns in UPGRADES:
        if version < number <= (to or newest):
            for name, default in columns.items():
                df = df if name in df.columns else df.withColumn(name, F.expr(default))
    return df


def hook_output(event: Column, context: Column) -> Column:
    return F.to_json(F.struct(F.struct(event.alias("hookEventName"), context.alias("additionalContext")).alias("hookSpecificOutput")))


def merged_capsule(content: Column, block: Column, begin: str = "<!-- memory:begin -->", end: str = "<!-- memory:end -->") -> Column:
    """The block put between its markers, or after the text where there are none."""
    whole = F.concat(F.lit(f"{begin}\n"), block, F.lit(f"\n{end}"))
    at, to = F.instr(content, begin), F.instr(content, end)
    inside = F.concat(F.substring(content, F.lit(1), at - 1), whole, F.substring(content, to + len(end), F.length(content)))
    return F.when((at > 0) & (to > at), inside).otherwise(F.concat(F.rtrim(F.regexp_replace(content, r"\s+$", "")), F.lit("\n\n"), whole, F.lit("\n")))
