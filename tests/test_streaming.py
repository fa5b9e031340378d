import datetime as dt
import os

from ledgerline.streaming import jobs

DAY = dt.datetime(2024, 1, 1)


def test_daily_counts_drop_what_is_later_than_the_watermark(spark, tmp_path):
    """Files in order: two days, then a day far on, twice, as rows are held late by the watermark of the batch before; then rows
    that are late: one within the watermark's day, one before it."""
    batches = [[(0, "a", 1.0), (0, "a", 2.0), (1, "b", 4.0)], [(5, "a", 8.0)], [(5, "c", 0.5)], [(0, "a", 100.0), (4, "b", 16.0)]]
    for k, rows in enumerate(batches):
        at = tmp_path / "in" / f"{k}"
        df = spark.createDataFrame([(DAY + dt.timedelta(days=d, hours=12), kind, v) for d, kind, v in rows], "ts timestamp, event_type string, value double")
        df.coalesce(1).write.parquet(str(at))
        for f in at.iterdir():  # files are taken by age
            os.utime(f, (1_700_000_000 + 60 * k, 1_700_000_000 + 60 * k))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = jobs.daily_counts(stream)
    query = out.writeStream.format("memory").queryName("daily").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    latest = {}
    for r in spark.table("daily").collect():
        latest[(r.day - DAY).days, r.kind] = max(latest.get(((r.day - DAY).days, r.kind), (0, 0)), (r.n, r.value))
    assert latest == {(0, "a"): (2, 3.0), (1, "b"): (1, 4.0), (5, "a"): (1, 8.0), (5, "c"): (1, 0.5), (4, "b"): (1, 16.0)}
    batch = {((r.day - DAY).days, r.kind): (r.n, r.value) for r in jobs.daily_counts(spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))).collect()}
    assert batch[0, "a"] == (3, 103.0)


def test_arriving_invoices(spark, tmp_path):
    entry = "pair_id long, items array<struct<line_no:int,item:string,qty:double,price:double>>"
    spark.createDataFrame([(1, [(1, "bolt", 2.0, 5.0)]), (2, [(1, "nut", 3.0, 6.0)]), (3, None)], entry).coalesce(1).write.parquet(str(tmp_path / "in"))
    po = spark.createDataFrame([(1, 1, "bolt", 2.0, 5.0), (2, 1, "nut", 30.0, 6.0), (3, 1, "cog", 1.0, 1.0), (9, 1, "x", 1.0, 1.0)], "pair_id long, line_no int, item string, qty double, price double")
    seen = {}
    jobs.verify_stream(jobs.read_arriving(spark, str(tmp_path / "in")), po, lambda out, n: seen.update({r.pair_id: (r.discrepancies, r.status) for r in out.collect()}), str(tmp_path / "c")).awaitTermination()
    assert seen == {1: (0, "No Discrepancies Found"), 2: (1, "Discrepancies Found"), 3: (1, "Discrepancies Found")}


def test_both_sides_arrive_in_any_order(spark, tmp_path):
    """Pair 1 in two batches, the order's side first; 2 in one; 3 only one side until its deadline is over; 4 repeats a side; 5 comes after its verdict."""
    from ledgerline.streaming import pairing

    at = lambda h: DAY + dt.timedelta(hours=h)
    bolt, nut = [(1, "bolt", 2.0, 5.0)], [(1, "bolt", 20.0, 5.0)]
    batches = [
        [(1, "po", at(0), bolt), (2, "invoice", at(0), bolt), (2, "po", at(1), nut), (3, "invoice", at(1), bolt), (4, "po", at(1), bolt)],
        [(1, "invoice", at(2), bolt), (4, "po", at(2), nut), (2, "invoice", at(2), nut), (None, "po", at(2), bolt), (7, "other", at(2), bolt)],
        [(4, "invoice", at(3), bolt), (6, "invoice", at(90), None)],
        [(8, "po", at(91), bolt)],
        [(3, "po", at(92), bolt), (9, "po", at(93), bolt)],
    ]
    for k, rows in enumerate(batches):
        folder = tmp_path / "in" / f"{k}"
        spark.createDataFrame(rows, pairing.ARRIVING).coalesce(1).write.parquet(str(folder))
        for f in folder.iterdir():
            os.utime(f, (1_700_000_000 + 60 * k, 1_700_000_000 + 60 * k))
    stream = spark.readStream.schema(pairing.ARRIVING).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    seen = []
    pairing.verify_both_sides(stream, lambda out, n: seen.extend(out.collect()), str(tmp_path / "c"), deadline_ms=6 * 3600 * 1000).awaitTermination()
    made = {r.pair_id: (r.discrepancies, r.status, r.warning is not None) for r in seen}
    ok, bad = "No Discrepancies Found", "Discrepancies Found"
    assert len(seen) == len(made) and {k: made[k] for k in (1, 2, 3, 4)} == {1: (0, ok, False), 2: (1, bad, False), 3: (1, bad, True), 4: (0, ok, False)}
    whole = spark.read.option("recursiveFileLookup", True).schema(pairing.ARRIVING).parquet(str(tmp_path / "in"))
    batch = {r.pair_id: (r.discrepancies, r.status, r.warning is not None) for r in pairing.verdicts(pairing.paired_table(whole)).collect()}
    assert {k: batch[k] for k in (1, 2, 4)} == {k: made[k] for k in (1, 2, 4)} and batch[8][2]
