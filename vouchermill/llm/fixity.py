"""Merkle fixity audit of web archives and their replicas.

Pages become WARC response records, in archives of consecutive page ids; a
record's offset is the prefix sum of the lengths before it. A tree's leaves are
the records (digest, offset, length); the leaves of each range of offsets make
a node, FAN neighbouring nodes make the next level's, up to the archive's root,
and the roots of archives go on in the same way to one root of all.

Two replicas are compared from the root down: only children of nodes that
differ are looked at, level by level, so an intact branch costs one comparison.

Defined cases: null urls and bodies are empty; records with equal page ids go
by digest; null ids are an archive of their own, numbered 0; a record that one
side lacks is `missing` or `extra`, and those behind it, whose offsets differ,
`moved`; two empty tables agree; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vouchermill.session import shared_folder

PER_ARCHIVE, RANGE_BYTES, FAN = 500, 1 << 16, 8


def record(url: Column, body: Column) -> Column:
    """The text of a response record."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame, per_archive: int = PER_ARCHIVE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record: archive, record (its number), page_id, copy (among equal ids), at
    (offset), node (its range of offsets), size, content (digest), digest (of the leaf)."""
    rows = pages.select("page_id", record(F.col("url"), F.col("html")).alias("record"))
    rows = rows.select(
        "page_id", F.coalesce(F.floor(F.col("page_id") / per_archive) + 1, F.lit(0)).alias("archive"),
        F.octet_length("record").cast("bigint").alias("size"), F.sha2("record", 256).alias("content"),
    )
    order = Window.partitionBy("archive").orderBy("page_id", "content")
    rows = rows.withColumn("record", F.row_number().over(order) - 1)
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("archive", "page_id").orderBy("content")))
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("at", F.coalesce(before, F.lit(0)))
    rows = rows.withColumn("node", F.floor(F.col("at") / range_bytes))
    return rows.withColumn("digest", F.sha2(F.concat_ws(":", "content", "at", "size"), 256))


@dataclass
class Tree:
    """A replica's tables: `leaves`, and level=1 (ranges of offsets) up to the root's."""

    folder: str
    levels: int

    def leaves(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/leaves")

    def level(self, spark: SparkSession, n: int) -> DataFrame:
        """archive, node, digest, and the parent's up_archive, up_node."""
        return spark.read.parquet(f"{self.folder}/level={n}")


def build_trees(
    replicas: list[DataFrame], per_archive: int = PER_ARCHIVE, range_bytes: int = RANGE_BYTES, fan: int = FAN
) -> list[Tree]:
    """Write the trees of replicas, all of the same height. Every level is made from the one below it."""
    spark = replicas[0].sparkSession
    trees, width, archives = [], 1, 1
    for pages in replicas:
        tree = Tree(shared_folder(spark, "fixity-tree"), 0)
        leaves(pages, per_archive, range_bytes).write.parquet(f"{tree.folder}/leaves")
        last, most = tree.leaves(spark).agg(F.max("node"), F.max("archive")).first()
        width, archives = max(width, (last or 0) + 1), max(archives, (most or 0) + 1)
        trees.append(tree)
    for tree in trees:
        rows = tree.leaves(spark).select("archive", "node", F.col("record").alias("child"), "digest")
        wide, many, level = width, archives, 1
        while True:
            rows = rows.groupBy("archive", "node").agg(F.sort_array(F.collect_list(F.struct("child", "digest"))).alias("c"))
            up_archive, up_node = F.col("archive"), F.floor(F.col("node") / fan)
            if wide <= 1:  # the archive's root: from here on over the archives
                up_archive, up_node = F.floor(F.col("archive") / fan), F.col("node")
            rows = rows.select(
                "archive", "node", F.sha2(F.array_join(F.col("c")["digest"], ""), 256).alias("digest"),
                up_archive.alias("up_archive"), up_node.alias("up_node"), F.lit(wide <= 1).alias("whole"),
            )
            rows.write.parquet(f"{tree.folder}/level={level}")
            tree.levels = level
            if wide <= 1 and many <= 1:
                break
            child = F.when(F.lit(wide <= 1), F.col("archive")).otherwise(F.col("node")).alias("child")
            rows = tree.level(spark, level).select(F.col("up_archive").alias("archive"), F.col("up_node").alias("node"), child, "digest")
            wide, many = (wide, -(-many // fan)) if wide <= 1 else (-(-wide // fan), many)
            level += 1
    return trees


def _differing(left: DataFrame, right: DataFrame, keys: list[str], bad: DataFrame | None, parent: list[str]) -> DataFrame:
    """Rows of both sides, joined by `keys`, whose digests differ, below the nodes of `bad`."""
    sides = []
    for rows, side in ((left, "a"), (right, "b")):
        if bad is not None:
            rows = rows.join(bad, [rows[p] == bad[b] for p, b in zip(parent, ("bad_archive", "bad_node"))], "left_semi")
        sides.append(rows.select(*[F.col(k) if k in keys else F.col(k).alias(f"{k}_{side}") for k in rows.columns]))
    on = [sides[0][k].eqNullSafe(sides[1][k]) for k in keys]
    both = sides[0].join(sides[1], on, "full_outer").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    own = [F.coalesce(sides[0][k], sides[1][k]).alias(k) for k in keys]
    return both.select(*own, *[c for c in both.columns if c not in keys])


def audit(left: Tree, right: Tree, spark: SparkSession) -> DataFrame:
    """Records in which the replicas differ: archive, page_id, copy (among equal ids),
    at (offset on the left, else right) and status. Starts at the roots.

    Each level's differing nodes are written, as both sides of the next level
    read them: the plan stays small however high the trees are."""
    bad = None
    for level in range(left.levels, 0, -1):
        found = _differing(left.level(spark, level), right.level(spark, level), ["archive", "node"], bad, ["up_archive", "up_node"])
        folder = shared_folder(spark, "fixity-differing")
        found.select(F.col("archive").alias("bad_archive"), F.col("node").alias("bad_node")).write.parquet(folder)
        bad = spark.read.parquet(folder)
    rows = _differing(left.leaves(spark), right.leaves(spark), ["archive", "page_id", "copy"], bad, ["archive", "node"])
    status = (
        F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra")
        .when(F.col("content_a") == F.col("content_b"), "moved").otherwise("altered")
    )
    return rows.select("archive", "page_id", "copy", F.coalesce("at_a", "at_b").alias("at"), status.alias("status"))


def report(left: Tree, right: Tree, spark: SparkSession) -> DataFrame:
    """One row per archive of either replica: archive, n_records, n_bytes (both of
    the left one, 0 if only the right has it), intact, n_altered, n_missing, n_moved,
    n_extra, bad_records (page:status, comma-joined)."""
    totals = left.leaves(spark).groupBy("archive").agg(F.count(F.lit(1)).alias("n_records"), F.sum("size").alias("n_bytes"))
    bad = audit(left, right, spark)
    counts = bad.groupBy(F.col("archive").alias("bad")).agg(
        *[F.sum((F.col("status") == s).cast("bigint")).alias(f"n_{s}") for s in ("altered", "missing", "moved", "extra")],
        F.sort_array(F.collect_list(F.struct("page_id", "copy", "status"))).alias("list"),
    )
    rows = totals.join(counts, F.col("archive") == F.col("bad"), "full_outer")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    listed = F.array_join(F.transform("list", lambda r: F.concat(F.coalesce(r["page_id"].cast("string"), F.lit("")), F.lit(":"), r["status"])), ",")
    return rows.select(
        F.coalesce("archive", "bad").cast("bigint").alias("archive"), none("n_records"), none("n_bytes"),
        F.col("bad").isNull().alias("intact"), none("n_altered"), none("n_missing"), none("n_moved"), none("n_extra"), F.coalesce(listed, F.lit("")).alias("bad_records"),
    )


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with planted damage: in pages 13 of 97 the first character of the
    body is another, and pages 7 of 5003 are lost."""
    body = F.when((F.col("page_id") % 97 == 13) & (F.octet_length(F.substring("html", 1, 1)) == 1),
                  F.concat(F.when(F.substring("html", 1, 1) == "?", "!").otherwise("?"), F.substring("html", F.lit(2), F.length("html"))))
    rows = pages.where(F.col("page_id").isNull() | (F.col("page_id") % 5003 != 7))
    return rows.select("page_id", "url", F.coalesce(body, F.col("html")).alias("html"))
