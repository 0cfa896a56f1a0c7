"""What the operators share: the tables, the shared working folder and graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters that are neither a blank nor one of U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='packloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/packloom/{name}-{uuid.uuid4().hex}"


#: The folders of the intermediate tables and archives that this process has made and not deleted.
_made: list[str] = []
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: it cuts the lineage and outlives lost executors.

    The shuffle files behind it are needed no more, and Spark deletes them as the write ends.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE, before) if before is not None else spark.conf.unset(_FREE)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._packloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def drop(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    path = getattr(df, "_packloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def made() -> list[str]:
    """The folders of the intermediate tables that are there."""
    return list(_made)


def release(docs: DataFrame, tables: list[str]) -> None:
    """Delete those of the tables, from made(), that docs does not read: for when the results made of them are written themselves."""
    read = docs.inputFiles()
    for path in tables:
        if path in _made and not any(path.rpartition("/")[2] in f for f in read):
            _delete(docs.sparkSession, path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the graph with the rows (a, b): one row (node, label) for each node, label the smallest node reached.

    Every round gives each node the smallest label among its neighbours and then follows labels one step (pointer
    jumping), so that the number of rounds grows with the logarithm of the longest path. Joins and minimums only: no
    component is gathered anywhere. Edges with a null end are left out.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    both = written(both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("got")), "b").groupBy(F.col("a").alias("node")).agg(F.min("got").alias("got"))
        hooked = labels.join(near, "node").select("node", F.least("label", "got").alias("label"), F.col("label").alias("before"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = written(hooked.join(up, "label", "left").select("node", F.least("label", F.coalesce("above", "label")).alias("label"), "before"), "labels")
        changed = not after.where("label <> before").isEmpty()
        drop(labels)
        labels = after.select("node", "label")
        labels._packloom_path = after._packloom_path
        if not changed:
            drop(both)
            return labels
