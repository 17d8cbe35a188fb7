"""Document fingerprints of closed syncmers over words.

A run of `k` words is an anchor when the smallest hash of its inner runs of
`s` words stands at the run's first or last place. Whether a run is an anchor
depends on its own words only, so an edit changes no anchor beyond the runs it
touches, and anchors of two texts can be matched by value and then by place.

Everything is Column expressions. Defined cases: a null text is an empty one;
an empty or wordless text has no anchors and an empty fingerprint; a text with
words but without such a run (always below k words, possible below 2k-s-1) is
one anchor, the hash of all its words; two texts with equal fingerprints, empty
ones too, are wholly alike; rows with equal or null ids
keep a row each (nulls come last, ties go by the text's hash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vouchermill.llm.words import hashes, with_grams, words

K, S = 5, 2
#: documents in one range of ids (a task sorts whole ranges), and the most ranges
RANGE_ROWS, MOST_RANGES = 20_000, 100_000
LOW_32 = 0xFFFFFFFF


def with_anchors(df: DataFrame, text: str, name: str, k: int = K, s: int = S) -> DataFrame:
    """Add `name`: array<struct<at int, hash bigint>>, a text's anchors in
    order; `at` counts words from 0, `hash` has 32 bits."""
    keep, p = df.columns, f"__{name}"
    df = df.withColumn(f"{p}_words", words(F.col(text))).withColumn(f"{p}_h", hashes(F.col(f"{p}_words")))
    df = with_grams(df, f"{p}_h", s, f"{p}_inner")
    df = with_grams(df, f"{p}_h", k, f"{p}_run")
    inner, n = F.col(f"{p}_inner"), F.size(f"{p}_h")

    def anchor(h, i):
        edge = F.least(inner[i], inner[i + (k - s)])
        between = [inner[i + j] for j in range(1, k - s)]
        at_edge = edge <= (F.least(*between) if len(between) > 1 else between[0]) if between else F.lit(True)
        return F.when(at_edge, F.struct(i.cast("int").alias("at"), h.bitwiseAND(LOW_32).alias("hash")))

    df = df.withColumn(f"{p}_all", F.array_compact(F.transform(f"{p}_run", anchor)))
    whole = F.xxhash64(f"{p}_words").bitwiseAND(LOW_32)
    short = F.array(F.struct(F.lit(0).alias("at"), whole.alias("hash")))
    return df.withColumn(name, F.when((n > 0) & (F.size(f"{p}_all") == 0), short).otherwise(F.col(f"{p}_all"))).select(*keep, name)


def fingerprint(anchors: str) -> Column:
    """Eight hex digits for each anchor, in the order of the text."""
    return F.array_join(F.transform(anchors, lambda a: F.lpad(F.lower(F.hex(a["hash"])), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Shared anchor values against the mean number of distinct ones (Dice)."""
    x, y = F.array_distinct(F.col(a)["hash"]), F.array_distinct(F.col(b)["hash"])
    total = F.size(x) + F.size(y)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / F.greatest(total, F.lit(1)))


def with_next(docs: DataFrame, partitioned) -> DataFrame:
    """Rows of `partitioned(docs)` with the columns `next_<c>` of the next
    document in descending doc_id order; the last document's next is the first.

    Ids are cut into ranges at quantiles. A range's first document also goes to
    the range before it (the very first to the last range), so every range has
    its rows' successors: texts are shuffled once, and no task orders them all.
    The driver gets the cuts only, at most MOST_RANGES numbers.
    """
    spark = docs.sparkSession
    rows, top = docs.agg(F.count(F.lit(1)), F.max("doc_id")).first()
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MOST_RANGES, max(-(-rows // RANGE_ROWS), min(least, rows // 16 + 1)))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)]) if ranges > 1 else F.array(F.lit(0.5))
    found = docs.agg(F.percentile_approx("doc_id", shares, 10 * ranges)).first()[0] or []
    cuts = sorted({top, *found}, reverse=True) if top is not None else []
    rows = docs.withColumn("__tie", F.xxhash64("text"))
    if len(cuts) > 1:
        step = max(1, int(len(cuts) ** 0.5))
        listed = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
        block = F.size(F.filter(listed(cuts[::step]), lambda c: c >= F.col("doc_id"))) - 1
        rows = rows.withColumn("__block", F.when(F.col("doc_id").isNotNull(), block))
        within = F.size(F.filter(F.slice(listed(cuts), F.col("__block") * step + 1, step), lambda c: c >= F.col("doc_id")))
        bucket = F.coalesce(F.col("__block") * step + within - 1, F.lit(len(cuts) - 1))
        rows = rows.withColumn("__range", bucket).drop("__block")
        first = F.coalesce(F.col("doc_id") == listed(cuts)[F.col("__range")], F.lit(False))
    else:
        rows = rows.withColumn("__range", F.lit(0))
        first = F.col("doc_id").eqNullSafe(F.lit(cuts[0] if cuts else None).cast("bigint"))
    back = F.when(F.col("__range") == 0, len(cuts) - 1 if cuts else 0).otherwise(F.col("__range") - 1)
    place = lambda r, again: F.struct(r.cast("int").alias("r"), F.lit(again).alias("again"))
    places = F.when(first, F.array(place(F.col("__range"), 0), place(back, 1))).otherwise(
        F.array(place(F.col("__range"), 0))
    )
    rows = rows.withColumn("__place", F.explode(places))
    rows = rows.select(*docs.columns, "__tie", F.col("__place.r").alias("__range"), F.col("__place.again").alias("__again"))
    rows = partitioned(rows.repartition("__range"))
    order = Window.partitionBy("__range").orderBy("__again", F.col("doc_id").desc_nulls_last(), "__tie")
    extra = [c for c in rows.columns if c not in ("__tie", "__range", "__again")]
    rows = rows.select(*extra, "__again", *[F.lead(c).over(order).alias(f"next_{c}") for c in extra if c != "doc_id"])
    return rows.where("__again = 0").drop("__again")


def compare_with_edits(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text (the last
    third replaced by the head of the next document) and how alike they are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_next(docs.select("doc_id", text.alias("text")), lambda d: with_anchors(d, "text", "anchors", k, s))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited", edited)
    rows = with_anchors(rows, "edited", "edited_anchors", k, s)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("anchors").alias("fingerprint"),
        fingerprint("edited_anchors").alias("edited_fingerprint"), likeness("anchors", "edited_anchors").alias("near_edited"),
        likeness("anchors", "next_anchors").alias("near_next"),
    )
