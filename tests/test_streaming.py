import datetime as dt
import os
import re

from pyspark.sql import functions as F

from conftest import rows_of
from vouchermill.operators import anomalies
from vouchermill.plans import catalog
from vouchermill.schemas import LEDGER, RAW_DAYBOOK
from vouchermill.streaming import baselines, ingest, scoring, totals


def land(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def run_ingest(spark, tmp_path, files_per_batch=1):
    ingest.ingest_daybook(
        spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "2024-25", files_per_batch
    ).awaitTermination()
    return rows_of(spark.read.schema(LEDGER).parquet(str(tmp_path / "out")), "txn_date", "vch_no", "debit_amount")


def test_ingest_in_steps(spark, tmp_path):
    land(
        tmp_path / "in", "a.csv",
        ["Date,Particulars,Vch Type,Vch No.,Debit,Credit", "2024-05-01, A ,GST Sales New,S1,10,", "2024-05-02,B,Contra,,5,",
         "2024-05-02,Grand Total,,,15,", "2024-05-03,A,Receipt,R1,,9"],
    )
    assert [r["vch_no"] for r in run_ingest(spark, tmp_path)] == ["S1", None, "R1"]
    # the next file repeats a voucher, has one without number and one new
    land(tmp_path / "in", "b.csv", ["2024-05-01,A,GST Sales New,S1,10,", "2024-05-02,B,Contra,,5,", "2024-06-01,C,Payment,Y1,7,"])
    got = run_ingest(spark, tmp_path)
    assert [(str(r["txn_date"]), r["vch_no"]) for r in got] == [
        ("2024-05-01", "S1"), ("2024-05-02", None), ("2024-05-02", None), ("2024-05-03", "R1"), ("2024-06-01", "Y1"),
    ]
    # every batch but the first has its own folder, and the start adds none
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["batch=-1", "batch=0", "batch=1"]
    assert got[0]["txn_category"] == "Sales" and got[0]["particulars"] == "A"
    # nothing new: nothing happens
    assert len(run_ingest(spark, tmp_path)) == 5


def test_ingest_loses_no_row_for_being_old(spark, tmp_path):
    """Unsorted and far-future dates, repeats years later; any number of files in a batch."""
    results = []
    for size in (1, 1000):
        folder = tmp_path / str(size)
        folder.mkdir()
        for name, date, number in (("a", "2025-06-01", 1), ("b", "2099-06-02", 2), ("c", "2015-06-01", 3), ("d", "2031-01-01", 1)):
            land(folder / "in", f"{name}.csv", [f"{date},A,GST Sales New,V/{number},10,"])
        got = run_ingest(spark, folder, size)
        assert sorted(r["vch_no"] for r in got) == ["V/1", "V/2", "V/3"]
        results.append(sorted((str(r["txn_date"]), r["vch_no"]) for r in got if r["vch_no"] != "V/1"))
    assert results[0] == results[1] == [("2015-06-01", "V/3"), ("2099-06-02", "V/2")]


def test_lines_of_a_voucher_stay_together(spark, tmp_path):
    """A number belongs to the book that brings it first: all its lines there stay, others go,
    for any number of files in a batch."""
    files = [
        ("a/1", ["2024-05-01,A,GST Sales New,V1,10,", "2024-05-01,A,Receipt,V1,,9", "2024-05-02,B,Payment,V2,7,"]),
        ("a/2", ["2024-05-03,A,Journal,V1,3,", "2024-05-03,A,GST Sales New,V1,10,"]),
        ("b/1", ["2024-05-01,A,GST Sales New,V1,10,", "2024-05-04,C,Payment,V3,1,", "2024-05-04,C,Contra,V3,,1", "2024-05-04,C,Contra,,,2"]),
    ]
    for book, want in (("folder", ["V1"] * 4 + ["V2", "V3", "V3", None]), ("file", ["V1"] * 2 + ["V2", "V3", "V3", None])):
        results = []
        for size in (1, 1000):
            root = tmp_path / f"{book}{size}"
            for i, (name, lines) in enumerate(files):
                path = root / "in" / f"{name}.csv"
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_text("\n".join(lines) + "\n")
                os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
            run = ingest.ingest_daybook(spark, f"{root}/in/*", f"{root}/out", f"{root}/cp", "2024-25", size, book)
            run.awaitTermination()
            rows = rows_of(spark.read.schema(LEDGER).parquet(f"{root}/out").drop("batch"), "vch_no", "txn_date", "vch_type", "txn_category")
            assert sorted(str(r["vch_no"]) for r in rows) == sorted(map(str, want))
            results.append(rows)
        assert results[0] == results[1]


def test_a_batch_reads_the_index_and_not_the_ledger(spark, tmp_path):
    batch = spark.createDataFrame([("V1", "b", (1, "x"))], "vch_no string, _book string, _arrived struct<t: int, p: string>")
    spark.createDataFrame([("V1", "a", 1), ("V9", "a", 2)], "vch_no string, book string, bucket int").withColumn(
        "bucket", ingest.bucket_of(F.col("vch_no"))
    ).write.partitionBy("bucket").parquet(str(tmp_path / "index/batch=0"))
    index = spark.read.schema(ingest.INDEX).parquet(str(tmp_path / "index"))
    assert ingest.first_books(batch, index).count() == 0 and ingest.own_lines(batch, index).count() == 0
    mine = batch.withColumn("_book", F.lit("a"))
    assert ingest.own_lines(mine, index).count() == 1


def test_the_text_of_a_batch_is_parsed_once(spark, tmp_path, monkeypatch):
    read, columns = [], []
    for name in ("first_books", "own_lines"):
        def spy(batch, index, call=getattr(ingest, name)):
            read.extend(batch.inputFiles())
            columns.append(batch.columns)
            return call(batch, index)

        monkeypatch.setattr(ingest, name, spy)
    land(tmp_path / "in", "a.csv", ["2024-05-01,A,GST Sales New,S1,10,", "01-05-2024,B,Receipt,,,5"])
    assert [r["fiscal_year"] for r in run_ingest(spark, tmp_path)] == ["2024-25"] * 2
    assert len(read) >= 2 and all(f.endswith(".parquet") for f in read)
    # columns that follow from others are made for the lines that stay only
    assert all("month_name" not in names for names in columns)


def test_files_of_a_book_grow_with_the_cores(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_ingested", lambda spark, raw, files_per_batch: (raw, files_per_batch))
    sheet = spark.createDataFrame([(f"2024-05-{i % 28 + 1:02}", "A", "Contra", f" V/{i}", "1", None) for i in range(60)], RAW_DAYBOOK)
    monkeypatch.setattr(catalog.tables, "raw_daybook", lambda spark, folder: sheet)
    raw, files_per_batch = catalog.stream_ingest_lines(spark, "")
    assert raw.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism == 4 and files_per_batch == 3


def test_a_batch_compares_entities_with_bucket_counts_only(spark, tmp_path):
    """The amounts, most of the log, are not joined to the batch's entities once more."""
    log = str(tmp_path / "log")
    df = spark.range(50).select(F.concat(F.lit("u"), "id").alias("who"), F.col("id").cast("decimal(18,2)").alias("value"))
    baselines.add_batch(df, 0, log, "who", "value")
    found = baselines.read_baselines(spark, log, "who", only=df.filter("who < 'u3'"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"LeftSemi.*_e#", plan)) == len(re.findall(r"level#\d+ = bucket", plan)) > 0


EVENTS = "ts timestamp_ntz, kind string, value decimal(18,2)"


def test_daily_totals_take_late_rows(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def add(rows):
        full = [(dt.datetime.fromisoformat(t), k, v) for t, k, v in rows]
        spark.createDataFrame(full, "ts timestamp_ntz, kind string, value double").select(
            "ts", "kind", F.col("value").cast("decimal(18,2)")
        ).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(EVENTS).parquet(source)
        totals.write_daily_totals(stream, target, str(tmp_path / "cp"), "ts", "kind", "value").awaitTermination()
        return rows_of(totals.read_daily_totals(spark, target), "day", "category")

    add([("2024-01-01T23:59:59", "a", 1.5), ("2024-01-02T00:00:00", "a", 2.0), ("2024-01-02T05:00:00", "b", 1.0)])
    run()
    # one day late: still counted
    add([("2024-01-01T10:00:00", "a", 4.0), ("2024-01-31T10:00:00", "a", 8.0)])
    got = run()
    assert [(str(r["day"]), r["category"], r["rows"], float(r["amount"])) for r in got] == [
        ("2024-01-01", "a", 2, 5.5), ("2024-01-02", "a", 1, 2.0), ("2024-01-02", "b", 1, 1.0), ("2024-01-31", "a", 1, 8.0),
    ]
    # a month late: no day ever closes
    add([("2024-01-01T11:00:00", "a", 100.0)])
    assert [float(r["amount"]) for r in run()] == [105.5, 2.0, 1.0, 8.0]
    # folding batches changes nothing, however often and up to whatever batch
    before = run()
    for upto in (0, 1, 1, 2, 0):
        totals.compact_daily_totals(spark, target, upto)
        assert rows_of(totals.read_daily_totals(spark, target), "day", "category") == before
    # a base that was not finished has no mark and counts for nothing
    spark.createDataFrame([(None, "a", 99, None)], "day date, category string, rows long, amount decimal(28,2)").write.parquet(f"{target}/kind=base/number=7")
    add([("2024-02-01T00:00:00", "c", 1.0)])
    assert len(run()) == len(before) + 1
    months = rows_of(totals.monthly_rollup(totals.read_daily_totals(spark, target)), "category")
    assert [(r["month"], r["category"], r["rows"], float(r["amount"])) for r in months] == [
        ("2024-01", "a", 5, 115.5), ("2024-01", "b", 1, 1.0), ("2024-02", "c", 1, 1.0),
    ]


def test_daily_totals_do_not_depend_on_batches(spark, tmp_path):
    """Days years apart in any order, one file or all in a batch."""
    days = ["2024-03-01", "2020-01-01", "2031-07-09", "2020-01-01"]
    for i, d in enumerate(days):
        row = spark.createDataFrame([(dt.datetime.fromisoformat(d), "a")], "ts timestamp_ntz, kind string")
        row.select("*", F.lit(1.5).cast("decimal(18,2)").alias("value")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    results = []
    for size in (1, 100):
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", size).parquet(str(tmp_path / "in/*"))
        target = str(tmp_path / f"out{size}")
        totals.write_daily_totals(stream, target, str(tmp_path / f"cp{size}"), "ts", "kind", "value").awaitTermination()
        results.append(rows_of(totals.read_daily_totals(spark, target), "day"))
    assert results[0] == results[1] and [r["rows"] for r in results[0]] == [2, 1, 1]


def test_scoring_equals_batch(spark, tmp_path):
    rows = [(i, "u1", float(v)) for i, v in enumerate([1, 1, 1, 1, 1, 50])] + [(9, "u2", 5.0)]
    df = spark.createDataFrame(rows, "id int, who string, value double").select("id", "who", F.col("value").cast("decimal(18,2)"))
    df.write.parquet(str(tmp_path / "in"))
    limits = anomalies.iqr_limits(df, "who", "value").filter("row_count >= 5")
    limits.write.parquet(str(tmp_path / "base"))
    stored = spark.read.schema(limits.schema).parquet(str(tmp_path / "base"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    flags = scoring.score_stream(stream, stored, "who", "value")
    scoring.write_flags(flags, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = rows_of(spark.read.schema(flags.schema).parquet(str(tmp_path / "out")))
    assert got == rows_of(anomalies.iqr_anomalies(df, "who", "value"))
    assert [r["id"] for r in got] == [5]


def test_baselines_grow_to_those_of_all_rows(spark, tmp_path):
    """One user owns most rows; amounts repeat, are negative or missing; any rows in a batch."""
    rows = [("hot", (i * 37) % 101 - 20 + i % 3 / 4) for i in range(900)] + [("few", 5.0)] * 3
    rows += [("u%d" % (i % 7), i * 1000.5) for i in range(60)] + [(None, 1.0), ("hot", None), ("huge", 9e13), ("huge", -9e13)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, who string, value double")
    df = df.withColumn("value", F.col("value").cast("decimal(18,2)"))
    want = rows_of(anomalies.iqr_limits(df.dropna(), "who", "value"), "who")
    for parts in (1, 5):
        log = str(tmp_path / f"log{parts}")
        for n in range(parts):
            batch = df.filter(F.col("id") % parts == n)
            baselines.add_batch(batch, n, log, "who", "value")
            baselines.add_batch(batch, n, log, "who", "value")  # a repeated batch counts once
        assert rows_of(baselines.read_baselines(spark, log, "who"), "who") == want
        for upto in (0, parts - 1, parts - 1, 0):
            baselines.compact_baselines(spark, log, upto)
            assert rows_of(baselines.read_baselines(spark, log, "who"), "who") == want
        some = df.filter("who in ('hot', 'u3')")
        assert [r["who"] for r in rows_of(baselines.read_baselines(spark, log, "who", only=some), "who")] == ["hot", "u3"]


def test_scoring_learns_from_earlier_batches_only(spark, tmp_path):
    """A batch's own rows do not count for it, a restart goes on, an unfinished repeat changes nothing."""
    schema = "id int, who string, value decimal(18,2)"

    def arrive(name, rows):
        full = spark.createDataFrame(rows, "id int, who string, value double").withColumn("value", F.col("value").cast("decimal(18,2)"))
        full.coalesce(1).write.parquet(str(tmp_path / f"in/{name}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        baselines.score_and_learn(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "who", "value").awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out/flags")).collect())

    assert arrive("a", [(i, "u", v) for i, v in enumerate([1.0] * 5 + [50.0])]) == []
    assert arrive("b", [(10, "u", 50.0), (11, "u", 1.0), (12, "v", 9.0)]) == [10]
    assert arrive("c", [(20, "v", 500.0), (21, "u", 40.0)]) == [10, 21]
    # the last batch's counts were written but not committed: it runs again
    before = rows_of(baselines.read_baselines(spark, str(tmp_path / "out/log"), "who"), "who")
    for name in ("2", ".2.crc"):
        (tmp_path / "cp/commits" / name).unlink()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
    baselines.score_and_learn(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "who", "value").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out/flags")).collect()) == [10, 21]
    assert rows_of(baselines.read_baselines(spark, str(tmp_path / "out/log"), "who"), "who") == before


def test_a_small_batch_opens_only_its_folders(spark, tmp_path):
    log = str(tmp_path / "log")
    df = spark.range(200).select(F.concat(F.lit("u"), "id").alias("who"), F.col("id").cast("decimal(18,2)").alias("value"))
    baselines.add_batch(df, 0, log, "who", "value")
    plan = baselines.read_baselines(spark, log, "who", only=df.filter("who = 'u7'"))._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
