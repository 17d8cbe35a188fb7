"""Benchmark decontamination: a broadcast set of the test items' word windows,
met by every window of the training texts.

The window hashes of the texts are exploded and joined with the broadcast set
in one pass, so that only windows that may match are ever materialised; each
is then compared word by word. A benchmark of more than `block` windows is
broadcast in several blocks, each with a pass of its own, so the size of a
broadcast is bounded whatever the benchmark.

Defined cases: a null or wordless text has no words and no hits; a null or
wordless item has no window; rows that repeat give a row each; a null doc_id
is a value like any other; columns that the operator does not name are left
alone; an empty benchmark marks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vouchermill.llm.words import free_name, hashes, row_key, with_grams, words
from vouchermill.session import shared_folder

WINDOW = 13
#: windows in one broadcast: at some 150 bytes each, no more than 75 MB
BLOCK = 500_000
#: a document is contaminated when a twentieth of its words is hit
SHARE = 20


def _grams(df: DataFrame, sizes: list[int]) -> DataFrame:
    """Columns `words`, `h` and, for each size, `g<size>`."""
    df = df.withColumn("words", words(F.col("text"))).withColumn("h", hashes(F.col("words")))
    for n in sizes:
        df = with_grams(df, "h", n, f"g{n}")
    return df.drop("h")


def _joined(at: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.col("words"), at, size), " ")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per item and distinct window: item, gram, size, string, wid.

    An item of fewer than `window` words, but not none, is one window.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    lengths = items.select(F.least(F.size(words(F.col("text"))), F.lit(window)).alias("n")).distinct()
    sizes = sorted(r.n for r in lengths.collect() if r.n)  # at most `window` numbers
    rows = _grams(items, sizes or [window]).withColumn("n", F.least(F.size("words"), F.lit(window)))
    choice = F.coalesce(*[F.when(F.col("n") == n, F.col(f"g{n}")) for n in sizes or [window]])
    rows = rows.select("item", "words", "n", F.posexplode(choice).alias("at", "gram"))
    rows = rows.select("item", "gram", F.col("n").alias("size"), _joined(F.col("at") + 1, F.col("n")).alias("string"))
    rows = rows.distinct().withColumn("wid", F.md5("string"))
    folder = shared_folder(spark, "benchmark-windows")
    rows.write.parquet(folder)
    return spark.read.parquet(folder)


def find_hits(docs: DataFrame, windows: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Verified occurrences: key, doc_id, n_words, at (from 1), size, wid. Each
    document also has one row with size 0, which carries its number of words.
    """
    distinct = windows.select("gram", "size", "string", "wid").distinct()
    sizes = sorted(r.size for r in distinct.select("size").distinct().collect()) or [window]
    blocks = max(1, -(-distinct.count() // block))
    docs = docs.select("doc_id", "text").withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    docs = _grams(docs, sizes).drop("text")
    mark = F.xxhash64(F.lit("one row per document"))
    found = None
    for b in range(blocks):
        part = distinct.where(F.pmod("gram", F.lit(blocks)) == b)
        arrays = []
        for i, n in enumerate(sizes):
            head = F.array(mark) if b == i == 0 else F.array(F.lit(0).cast("bigint"))
            arrays.append(F.struct(F.lit(n).alias("n"), F.concat(head, F.col(f"g{n}")).alias("grams")))
        if b == 0:
            own = part.sparkSession.range(1).select(
                mark.alias("gram"), F.lit(0).alias("size"), F.lit("").alias("string"), F.lit("").alias("wid")
            )
            part = part.unionByName(own)
        rows = docs.select("key", "doc_id", "words", F.explode(F.array(*arrays)).alias("a")) if len(sizes) > 1 else (
            docs.select("key", "doc_id", "words", arrays[0].alias("a"))
        )
        rows = rows.select("key", "doc_id", "words", F.col("a.n").alias("n"), F.posexplode("a.grams").alias("at", "gram"))
        rows = rows.join(F.broadcast(part), "gram")
        same = (F.col("n") == F.col("size")) & (_joined(F.greatest(F.col("at"), F.lit(1)), F.col("n")) == F.col("string"))
        rows = rows.where(F.when(F.col("at") == 0, F.col("size") == 0).otherwise(same))
        rows = rows.select("key", "doc_id", F.size("words").alias("n_words"), "at", "size", "wid")
        found = rows if found is None else found.unionByName(rows)
    return found


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, block: int = BLOCK
) -> DataFrame:
    """One row per document: doc_id, key, n_words, n_hit, n_items, items_sha256
    and contaminated (some word is hit, and at least 1 in `share`)."""
    windows = benchmark_windows(benchmark, window)
    folder = shared_folder(docs.sparkSession, "window-hits")
    find_hits(docs, windows, window, block).write.parquet(folder)  # few rows, used twice
    hits = docs.sparkSession.read.parquet(folder)
    before = Window.partitionBy("key").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("size")
    fresh = end - F.greatest(F.col("at"), F.coalesce(F.max(end).over(before), F.lit(0)))
    real = hits.where("size > 0").select("key", "at", "size", "wid").distinct()
    covered = real.select("key", F.greatest(fresh, F.lit(0)).alias("fresh")).groupBy("key")
    covered = covered.agg(F.sum("fresh").alias("n_hit"))
    items = real.select("key", "wid").distinct().join(windows.select("wid", "item").distinct(), "wid")
    items = items.select("key", "item").distinct().groupBy("key")
    items = items.agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item")).alias("items"))
    rows = hits.where("size = 0").select("key", "doc_id", "n_words")
    rows = rows.join(covered, "key", "left").join(items, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return rows.select(
        "doc_id", "key", F.col("n_words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    name = free_name(docs, "key")
    bad = contamination(docs, benchmark, **options).where("contaminated").select(F.col("key").alias(name)).distinct()
    rows = docs.withColumn(name, row_key(docs["doc_id"], docs["text"]))
    return rows.join(bad, name, "left_anti").drop(name)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The documents with every hit word cut out of `text`, and the breaks
    before it. Texts without a hit stay as they are."""
    hits = find_hits(docs, benchmark_windows(benchmark, window), window, block).where("size > 0")
    spots = hits.select("key", F.explode(F.expr("sequence(at, at + size - 1)")).alias("at")).distinct()
    key, places, known = (free_name(docs, n) for n in ("hit_key", "hit_places", "hit_map"))
    spots = spots.groupBy(F.col("key").alias(key)).agg(F.collect_list("at").alias(places))
    rows = docs.withColumn(key, row_key(docs["doc_id"], docs["text"])).join(spots, key, "left")
    rows = rows.withColumn(known, F.map_from_arrays(places, F.transform(places, lambda _: F.lit(True))))
    word = BREAKS_AND_WORD
    pieces = F.regexp_extract_all(F.col("text"), F.lit(word), F.lit(0))
    tail = F.regexp_extract(F.col("text"), r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\z", 1)
    kept = F.filter(pieces, lambda p, i: F.col(known)[i + 1].isNull())
    cut = F.concat(F.array_join(kept, ""), tail)
    return rows.withColumn("text", F.when(F.col(places).isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)


#: the breaks before a word and the word, in the text as it is (capitals are word characters)
BREAKS_AND_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
