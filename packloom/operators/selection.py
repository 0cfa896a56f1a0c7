"""Which files are kept, and why others are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions import globs
from packloom.functions import text as X

# Fixed values
MAX_FILE_BYTES = 1 << 20
IMAGE_LIKE = ("svg", "png", "jpg", "woff2")
NEVER = (".git", "target")


def with_parts(files: DataFrame) -> DataFrame:
    p = F.col("path")
    return files.withColumns({"name": X.file_name(p), "ext": X.extension(p), "stem": X.stem(p)})


def in_excluded_component(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, NEVER)))


def named_out() -> Column:
    return F.col("name").endswith(".lock") | F.col("name").endswith("-lock.json") | F.col("ext").isin(*IMAGE_LIKE) | F.col("stem").endswith(".min")


def ignored(patterns: list[str]) -> Column:
    out = F.lit(False)
    for r in globs.ignore_regexes(patterns):
        out = out | F.col("path").rlike(r) | F.col("name").rlike(r)
    return out


def overridden(patterns: list[str]) -> Column:
    """Whether a path or a folder above it is pruned from a walk: as ignored(), but a star stops at "/" and only paths are matched."""
    out = F.lit(False)
    for p in patterns:
        if regex := globs.to_regex(globs.normalize(p), star_crosses=False):
            out = out | F.col("path").rlike(regex[:-1] + "(?:/.*)?$")
    return out


def skip_reason(limit: int = MAX_FILE_BYTES, patterns: list[str] | None = None, no_limit: bool = False) -> Column:
    out = F.when(ignored(patterns or []), "ignored")
    return out if no_limit else F.when(F.col("size") > limit, "size").when(named_out(), "name").otherwise(out)


def partition(files: DataFrame, limit: int = MAX_FILE_BYTES, patterns: list[str] | None = None, no_limit: bool = False) -> DataFrame:
    """Every file with the reason for which it is skipped, null for those kept; one pass."""
    return with_parts(files).withColumn("skip_reason", skip_reason(limit, patterns, no_limit))


def readable(files: DataFrame, content: str = "content") -> DataFrame:
    """The files that are not binary and are valid UTF-8, with their text."""
    checked = files.where(~X.is_binary(F.col(content))).withColumn("text", F.try_validate_utf8(F.col(content).cast("string")))
    return checked.where("text is not null")
