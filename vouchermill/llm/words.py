"""Words and word grams as Column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: everything between words: ASCII apart from digits and lower-case letters
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that the table does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK)
    return F.array_remove(parts, "")


def row_key(identity: Column, text: Column) -> Column:
    """Digest of a row's id and text. Rows that repeat in both share it, and so
    do their results; a missing id is a value of its own."""
    return F.md5(F.concat(F.coalesce(identity.cast("string"), F.lit("-")), F.lit("\x1f"), F.coalesce(text, F.lit(""))))


def hashes(words_column: Column) -> Column:
    return F.transform(words_column, lambda w: F.xxhash64(w))


def _pair(left: str, right: str, shift: int) -> Column:
    """Hash of left[i] and right[i + shift] for every i for which both exist."""
    n = F.greatest(F.size(right) - shift, F.lit(0))
    return F.zip_with(
        F.slice(F.col(left), F.lit(1), n), F.slice(F.col(right), F.lit(shift + 1), n), lambda a, b: F.xxhash64(a, b)
    )


def with_grams(df: DataFrame, source: str, size: int, name: str) -> DataFrame:
    """Add the hashes of all runs of `size` elements of an array of hashes.

    Runs of 2, 4, 8 … are hashed from two halves, and `size` is put together
    from those: about log2(size) passes instead of `size`. Every pass is a
    column of its own, since Spark would evaluate a nested expression again
    at each of its uses.
    """
    keep, made = df.columns, {1: source}
    while 2 * max(made) <= size:
        k = max(made)
        df = df.withColumn(f"{name}__{2 * k}", _pair(made[k], made[k], k))
        made[2 * k] = f"{name}__{2 * k}"
    done, current = 0, ""
    for k in sorted(made, reverse=True):
        if size & k:
            if done:
                df = df.withColumn(f"{name}__to{done + k}", _pair(current, made[k], done))
                current = f"{name}__to{done + k}"
            else:
                current = made[k]
            done += k
    return df.select(*[F.col(c) for c in keep], F.col(current).alias(name))
