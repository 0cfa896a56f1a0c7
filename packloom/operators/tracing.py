"""The closure of files that an entry reaches."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Levels that are followed one by one, before those that are left are taken by jumps.
MAX_LEVELS = 8


def cut(df: DataFrame) -> DataFrame:
    """The rows, made once: a reliable checkpoint in the shared folder. Where no folder is set (local runs), in one of this machine."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp()}")
    return df.checkpoint()


def reachable(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """node and depth for all that the entries (node) reach over edges (src, dst), themselves included; cycles end.

    One join a level, against the nodes not seen before; the lineage is cut by a reliable checkpoint at each level. What is
    not reached in MAX_LEVELS levels is reached by _far(), so that a long chain does not take a join for each of its nodes.
    """
    edges = cut(edges.select("src", "dst").where("dst is not null").distinct())
    levels = [cut(entries.select("node").distinct().withColumn("depth", F.lit(0)))]
    while not levels[-1].isEmpty():
        seen = functools.reduce(DataFrame.unionByName, levels)
        if len(levels) > MAX_LEVELS:
            return _far(cut(seen), edges)
        step = levels[-1].join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        levels.append(cut(step.join(seen.select("node"), "node", "left_anti")))
    return functools.reduce(DataFrame.unionByName, levels)


def _far(best: DataFrame, edges: DataFrame) -> DataFrame:
    """node and the least depth for all that the nodes of best (node, depth) reach.

    Nodes with one edge make chains. Along these, jumps of 1, 2, 4 and more steps are joined with all that is reached, which
    has then all that lies fewer steps on than the next jump; a jump that finds nothing new, or nearer, is the last. In turn
    with that, one step is made over the edges of nodes with several. So there are as many rounds as a path has such nodes,
    each with joins in number as the logarithm of the longest chain.
    """
    one = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst"))
    jumps, several = [cut(one.where("n = 1").select("src", "dst"))], cut(edges.join(one.where("n > 1").select("src"), "src", "left_semi"))
    branches, size = not several.isEmpty(), _size(best)

    def nearer(best: DataFrame, over: DataFrame, steps: int) -> tuple[DataFrame, tuple]:
        found = best.join(over, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("depth") + steps).alias("depth"))
        after = cut(best.unionByName(found).groupBy("node").agg(F.min("depth").alias("depth")))
        return after, _size(after)

    while True:
        k = 0
        while True:
            if k == len(jumps):
                last = jumps[-1]
                jumps.append(cut(last.select("src", F.col("dst").alias("via")).join(last.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")))
            before, (best, size) = size, nearer(best, jumps[k], 1 << k)
            if size == before:
                break
            k += 1
        if not branches:
            return best
        before, (best, size) = size, nearer(best, several, 1)
        if size == before:
            return best


def _size(best: DataFrame) -> tuple:
    """Differs where nodes came in or came nearer."""
    return tuple(best.agg(F.count(F.lit(1)), F.sum("depth")).first())


def by_path(files: DataFrame) -> DataFrame:
    """Files in the order of their paths' components."""
    return files.orderBy(F.split("path", "/"))


def ranked(rows: DataFrame, name: str = "seq", first: int = 0) -> DataFrame:
    """rows with a gapless rank in the order of path components, counted in range partitions: no task sees all rows.

    The partitions are fixed by a checkpoint, as Spark may draw their borders anew each time; their numbers of rows, one
    row a partition, are summed in one task. Equal paths have ranks in any order.
    """
    placed = cut(rows.repartitionByRange(F.split("path", "/")).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_part").orderBy(F.split("path", "/"))
    nth = (F.col("_start") + F.row_number().over(own) - 1 + first).cast("long")
    return placed.join(starts, "_part").withColumn(name, nth).drop("_part", "_start")
