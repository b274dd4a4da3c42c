"""JSON-lines scans and canonical JSON-lines sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paritymill.functions.columns import decimal_text
from paritymill.functions.safety import redact_payload


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines with the file, the block of the file and the place in the task they came from."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(listed).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
    )


def _is_object() -> Column:
    return F.trim("line").startswith("{") & F.try_parse_json("line").isNotNull()


def _numbered(bad: DataFrame, lines: DataFrame) -> DataFrame:
    """Line numbers from 1 of ``bad``: lines of earlier blocks of the file, and before it in its own.

    One row per file block is counted; the lines themselves are not moved.
    """
    blocks = lines.groupBy("source_path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy("source_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "source_path", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    number = F.col("_before") + F.col("_place") - F.col("_first") + 1
    return bad.join(starts, ["source_path", "_block"]).withColumn("line_number", number)


def read_jsonl(
    spark: SparkSession, paths: str | Sequence[str], schema: str, mode: str = "strict", redact: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(records, quarantined lines) of JSON-lines files.

    strict: a malformed or non-object line fails the read, whatever columns are asked for.
    quarantine: such lines become rows of the second table (source_path, line_number, warning);
    good rows are kept.  The text of a bad line is not kept: it cannot be redacted safely.
    ``redact`` hides secret values of valid objects before they are parsed.
    """
    lines = _lines(spark, paths)
    filled = lines.where(F.trim("line") != "").withColumn("_ok", _is_object())
    bad = _numbered(filled.where(~F.col("_ok")).select("source_path", "_block", "_place"), lines).select(
        "source_path", "line_number", F.lit("CORRUPT_JSONL").alias("warning")
    )
    if mode == "strict":
        place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
        failed = F.concat(
            F.lit("malformed JSON line in "), F.col("source_path"), F.lit(", block at byte "), F.col("_block").cast("string"),
            F.lit(", line "), place.cast("string"), F.lit(" of its task"),
        )
        good = filled.where(F.when(F.col("_ok"), F.lit(True)).otherwise(F.raise_error(failed).cast("boolean")))
    elif mode == "quarantine":
        good = filled.where("_ok")
    else:
        raise ValueError("mode must be strict or quarantine")
    good = good.select("line", "source_path")
    if redact:
        good = redact_payload(good, "line")
    return good.select(F.from_json("line", schema).alias("_r"), "source_path").select("_r.*", "source_path"), bad


def read_mixed(spark: SparkSession, sources: Sequence[tuple[str, str]]) -> DataFrame:
    """One record set from several artifacts, each with its own schema."""
    out = None
    for path, schema in sources:
        records, _ = read_jsonl(spark, path, schema)
        out = records if out is None else out.unionByName(records, allowMissingColumns=True)
    if out is None:
        raise ValueError("at least one source is required")
    return out


def _as_json(c: Column, kind: str) -> Column:
    if kind.startswith("decimal"):
        return decimal_text(c)
    if kind == "timestamp":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    if kind == "date":
        return c.cast("string")
    return c


def canonical_lines(df: DataFrame) -> DataFrame:
    """One compact JSON object per row: sorted keys, decimals as text, clocks as ISO."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    struct = F.struct(*[_as_json(F.col(f.name), f.dataType.simpleString()).alias(f.name) for f in fields])
    return df.select(F.to_json(struct, {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write or append canonical JSON lines; every task writes its own part file."""
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be overwrite or append")
    canonical_lines(df).write.mode(mode).text(path)
