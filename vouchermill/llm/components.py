"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vouchermill.session import shared_folder


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b): the root is the
    component's least node, and has a row too.

    Each round links all larger neighbours of a node, then all smaller ones, to
    the least of them. The number of rounds grows with the logarithm of the
    longest path; edges never become more. Every round is written to the shared
    folder, so a lost executor costs one round at most.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> DataFrame:
        folder = shared_folder(spark, "edges")
        df.write.parquet(folder)
        return spark.read.parquet(folder)

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    rows = written(edges.where("a != b").select(high, low).distinct())
    nodes = rows.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    before = mark(rows)
    while before[0]:
        both = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        rows = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = rows.groupBy("a").agg(F.min("b").alias("m"))
        onward = rows.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        rows = written(onward.unionByName(least.select("a", F.col("m").alias("b"))).select(high, low).distinct())
        after = mark(rows)
        if after == before:
            break
        before = after
    roots = rows.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
