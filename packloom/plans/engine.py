"""Whole runs: choose files, clean them, pack them, write the document."""

from __future__ import annotations

import itertools
import os
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.functions import udfs
from packloom.operators import packing, resolving, selection
from packloom.sources import tree

#: Where the document goes if a sink fails.
FALLBACK = "packed-context.md"


def _files(spark: SparkSession, path: str, mode: str, ignore: list[str]) -> tuple[DataFrame, str]:
    if mode == "diff":
        return tree.changed_files(spark, path), path
    if mode == "trace" and os.path.isfile(path):
        return trace(spark, path), ""
    return tree.scan_tree(spark, path, ignore), ""


def trace(spark: SparkSession, entry: str, project: str | None = None) -> DataFrame:
    """seq, path and size of the files that an entry file reaches over imports, in the order of path components.

    Candidates are looked up in the file system, a level at a time: ignore rules do not hold, and a file may lie anywhere,
    or with project anywhere below it.
    """
    below = os.path.realpath(project).strip("/") + "/" if project else ""
    frontier = {os.path.realpath(entry).lstrip("/")}
    seen, marks, configs, looked = set(frontier), set(), {}, set()
    while frontier:
        files = selection.with_parts(spark.createDataFrame([(p,) for p in sorted(frontier)], "path string")).withColumn("folder", F.regexp_replace("path", r"/?[^/]*$", ""))
        tree.look_up({os.path.dirname(p) for p in frontier}, looked, marks, configs)
        read = selection.readable(tree.with_content(files.where(F.col("ext").isin(*resolving.CANDIDATES, *resolving.OTHER, "rs")), "/"))
        parsed = read.withColumn("specs", udfs.extract_imports("text", "ext")).drop("content", "text")
        roots = resolving.project_roots(files, spark.createDataFrame([(m,) for m in sorted(marks)], "path string"))
        patterns = resolving.aliases(files, spark.createDataFrame(sorted(configs.items()), "path string, json string")) if configs else None
        tried = resolving.candidates(parsed, roots, patterns).withColumn("real", tree.real_file("dst")).where(F.col("real").startswith(below))
        reached = tried.groupBy("src", "ord", "spec").agg(F.min_by("real", "prio").alias("real")).select("real").distinct()
        frontier = {r["real"] for r in reached.collect()} - seen
        seen |= frontier
    rows = [(i, f"/{p}", os.path.getsize(f"/{p}")) for i, p in enumerate(sorted(seen, key=lambda p: p.split("/")))]
    return spark.createDataFrame(rows, "seq bigint, path string, size bigint")


def select(spark: SparkSession, path: str = ".", mode: str = "scan", no_limit: bool = False, config: tree.Config | None = None) -> DataFrame:
    """The dry run: every file with its skip_reason, null for those selected; no content is read."""
    config = config or tree.load_config()
    files, _ = _files(spark, path, mode, config.global_ignore)
    return selection.partition(files, patterns=config.global_ignore, no_limit=no_limit)


def deliver(parts: Iterable[str], output: str | None = None, sink: Callable[[str], None] | None = None, fallback: str = FALLBACK) -> None:
    """Write the document to a file, or hand it to a sink such as a clipboard; where the sink fails, to the fallback file."""
    if output is None and sink is not None:
        parts = ["".join(parts)]
        try:
            return sink(parts[0])
        except Exception as e:
            print(f"warning: {e}; written to {fallback}", file=sys.stderr)
    if output or sink:
        with open(output or fallback, "w", encoding="utf-8", newline="") as f:
            f.writelines(parts)
    return None


def pack(spark: SparkSession, path: str = ".", mode: str = "scan", minify: bool = False, no_limit: bool = False, output: str | None = None, config: tree.Config | None = None, sink: Callable[[str], None] | None = None, fallback: str = FALLBACK) -> tuple[str | None, dict | None]:
    """The packed document and its statistics; (None, None), and nothing written, if no file is selected.

    The document goes to the file `output`, or else to `sink`, or to neither. One that is too large for one row is
    streamed to its file in the order of its blocks, and None stands in its place.
    """
    config = config or tree.load_config()
    files, base = _files(spark, path, mode, config.global_ignore)
    split = selection.partition(files, patterns=config.global_ignore, no_limit=no_limit)
    kept = split.where("skip_reason is null")
    if kept.isEmpty():
        return None, None
    read = selection.readable(tree.with_content(kept, base))
    minify = minify or config.default_minify
    limit = (packing.DEFAULT_MAX_MB if config.max_output_mb is None else config.max_output_mb) << 20
    budgeted = packing.with_budget(packing.sized(packing.process(read, minify)), limit)
    stats = packing.stats(budgeted, split.where("skip_reason is not null")).first().asDict()
    if stats["output_bytes"] > packing.MAX_ROW_BYTES:
        if not output:
            raise ValueError(f"a document of {stats['output_bytes']} bytes needs an output file")
        body = (r["block"] for r in packing.document_blocks(read, budgeted, minify).toLocalIterator())
        deliver(itertools.chain([packing.HEADER], body, [packing.TRAILER] * stats["truncated"]), output)
        return None, stats
    text = packing.document(read, budgeted, minify).first()["document"]
    deliver([text], output, sink, fallback)
    return text, stats
