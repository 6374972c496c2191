"""Text search over files or pages (S33-S35) and the flat configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text(spark: SparkSession, path: str, most: int = 256 * 1024) -> DataFrame:
    """[S33] Whole files as rows, refused (null) above the bound."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return files.select("path", bounded_text(F.col("value"), most).alias("text"))


def bounded_text(text: Column, most: int) -> Column:
    """[S33] A text of at most so many bytes, else null."""
    return F.when(F.octet_length(text) <= most, text)


def read_fixture(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """[S38] Recorded model output, a JSON object or array of objects a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def grep(pages: DataFrame, pattern: str, text: str = "text", key: str = "path", context: int = 0, ignore_case: bool = False, literal: bool = False) -> DataFrame:
    """[S34] Matching lines, with ``context`` lines before and after, of every page.

    One pass within each page: a line is taken if one near it matches.
    """
    import re

    pattern = re.escape(pattern) if literal else pattern
    pattern = f"(?i){pattern}" if ignore_case else pattern
    lines = pages.select(key, F.split(text, "\n").alias("lines"))
    hits = lines.withColumn("hits", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(pattern))).filter(F.size("hits") > 0)
    near = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(F.greatest(h - context, F.lit(0)), F.least(h + context, F.size("lines") - 1))))))
    out = hits.select(key, "lines", "hits", F.explode(near).alias("i"))
    return out.select(key, (F.col("i") + 1).alias("line"), F.get("lines", F.col("i")).alias("text"), F.array_contains("hits", F.col("i")).alias("is_match"))


def glob(spark: SparkSession, path: str, pattern: str, limit: int = 100) -> DataFrame:
    """[S35] Paths in order, at most ``limit``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path").orderBy("path").limit(limit)


@dataclass(frozen=True)
class Config:
    """[S36] Settings with their bounds."""

    max_records: int = 200
    max_bytes: int = 80_000
    retention_days: int = 14
    min_confidence_bp: int = 7500
    staleness_max: float = 0.8
    max_selected: int = 3

    BOUNDS = {"max_records": (1, 500), "max_bytes": (1, 1_000_000), "min_confidence_bp": (0, 10000), "staleness_max": (0.0, 1.0), "max_selected": (0, 3)}

    @classmethod
    def parse(cls, text: str, env: dict[str, str] | None = None) -> Config:
        """Flat ``key = value`` lines, then ``TRACEWELL_KEY`` overrides; values are brought within bounds."""
        found = dict(line.split("#")[0].split("=", 1) for line in text.splitlines() if "=" in line.split("#")[0])
        found = {k.strip(): v.strip().strip('"') for k, v in found.items()}
        found |= {k[10:].lower(): v for k, v in (env or {}).items() if k.startswith("TRACEWELL_")}
        out = cls()
        for f in fields(cls):
            if f.name in found:
                value = type(getattr(out, f.name))(float(found[f.name]))
                low, high = cls.BOUNDS.get(f.name, (value, value))
                out = replace(out, **{f.name: min(max(value, low), high)})
        if out.retention_days not in (7, 14, 30):
            out = replace(out, retention_days=14)
        return out
