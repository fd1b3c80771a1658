"""Helpers the operators of this subpackage share: tables, scratch tables, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogweave.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and survives lost executors. The
    shuffle files of the job that writes it go with the job, as nothing reads them again."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREED, before)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def give_back(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made. Only for those that nothing will read again: what was
    made from them has been written itself, so a lost executor does not need them either."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(table))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either the smaller end of its edges or the larger one of a single
    edge, so that no step would change anything."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.where("up + down > 1 and up > 0").agg(F.count("*")).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return (
        both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def nearer(edges: DataFrame) -> DataFrame:
    """Edges (a, b), b the smaller, with the components of the given ones after a large-star and a
    small-star step, written: nodes are at their component's smallest or closer to it."""
    return written(_small_star(_large_star(edges)), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node it reaches.

    edges(a long, b long), in any direction. Alternates large-star and small-star steps, so
    the number of rounds grows with the logarithm of the longest path; every step is written
    to the shared folder, and no node's neighbours are gathered in one task. So is the result.
    """
    edges = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    while not _are_stars(edges):
        last, edges = edges, nearer(edges)
        give_back(last)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    found = written(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), "roots")
    give_back(edges)
    return found


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows: what is made for each row is held for few at once,
    and a worker keeps no large heap from task to task."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_arrow(df: DataFrame, batches: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(batches, schema)
