"""Late and duplicate stream events on hand-made files."""
import datetime as dt

from pyspark.sql import functions as F

from quarry.streaming import streams as ST


def test_dedupe_and_late_rows(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = [(1, t, 1, "view", 1.0, '{"k": 1}'), (1, t, 1, "view", 1.0, '{"k": 1}'),
            (2, t + dt.timedelta(minutes=30), 2, "error", 2.0, '{"k": 2}')]
    late = [(3, t - dt.timedelta(minutes=40), 3, "view", 3.0, '{"k": 3}')]
    schema = ST.EVENTS_SCHEMA
    src = str(tmp_path / "files")
    spark.createDataFrame(rows, schema).withColumn("event_day", F.lit("2024-01-01").cast("date")) \
        .coalesce(1).write.mode("append").parquet(src)
    s = ST.event_stream(spark, src, files_per_batch=1)
    d = ST.dedupe(ST.log_stream(s)).select("id")
    ST.run_available_now(d, str(tmp_path / "out"), str(tmp_path / "ck"))
    spark.createDataFrame(late, schema).withColumn("event_day", F.lit("2024-01-01").cast("date")) \
        .coalesce(1).write.mode("append").parquet(src)
    ST.run_available_now(d, str(tmp_path / "out"), str(tmp_path / "ck"))
    ids = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert ids == [1, 2]  # duplicate dropped; row 40 min behind the watermark dropped


def _write(spark, path, rows):
    spark.createDataFrame(rows, "request_id long, ts timestamp").coalesce(1) \
        .write.mode("append").parquet(path)


def test_pair_with_expiry_across_batches(spark, tmp_path):
    """An end read a batch before its start still closes the request."""
    t = dt.datetime(2024, 1, 1, 12, 0, 0)
    sp, ep, out, ck = (str(tmp_path / x) for x in ("s", "e", "out", "ck"))
    schema = "request_id long, ts timestamp"

    def run():
        starts = spark.readStream.schema(schema).parquet(sp)
        ends = spark.readStream.schema(schema).parquet(ep)
        ST.run_available_now(ST.pair_with_expiry(starts, ends), out, ck)

    _write(spark, sp, [(2, t + dt.timedelta(seconds=5))])
    _write(spark, ep, [(1, t + dt.timedelta(seconds=2)), (3, t + dt.timedelta(seconds=7))])
    run()
    _write(spark, sp, [(1, t), (9, t + dt.timedelta(hours=1))])
    _write(spark, ep, [(8, t + dt.timedelta(hours=1))])
    run()
    run()
    got = {r.request_id: (r.state, r.duration_s) for r in spark.read.parquet(out).collect()}
    # 2 never ends: expired once the watermark (13:00 - 10 min) passes 12:01:05;
    # 8 and 9 are still inside their time bound and stay in state
    assert got == {1: ("closed", 2.0), 2: ("expired", None), 3: ("unmatched_end", 0.0)}


def test_ingest_again_adds_no_rows(spark, tmp_path):
    from quarry.functions import rules as R
    src, ok, bad, ck = (str(tmp_path / x) for x in ("src", "ok", "bad", "ck"))
    spark.range(10).selectExpr("id", "cast(id as double) v").write.parquet(src)
    log = spark.readStream.schema("id long, v double").parquet(src)
    for _ in range(2):
        ST.ingest(log, [R.bounds("v", gt=2)], ok, bad, ck)
    assert (spark.read.parquet(ok).count(), spark.read.parquet(bad).count()) == (7, 3)


def test_increases_go_on_after_a_restart(spark, tmp_path):
    """A counter that resets, read in two runs from one checkpoint: the first
    increase of the second run is against the last sample of the first."""
    def samples(rows):
        return spark.createDataFrame([(k, s, v) for k, s, v in rows], "k string, s long, v long").select(
            "k", F.timestamp_seconds("s").alias("ts"), "v")

    one = [("a", 100, 5), ("a", 111, 9), ("b", 105, 1), ("a", 5000, 9)]
    two = [("a", 5012, 12), ("a", 5031, 3), ("b", 5015, 1), ("b", 5033, 4), ("a", 99_999, 7)]
    for i, rows in enumerate((one, two)):
        samples(rows).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, ts timestamp, v long").parquet(
            str(tmp_path / "in")).withWatermark("ts", "10 minutes")
        ST.run_available_now(ST.increase_stream(stream, ["k"], "v"), str(tmp_path / "out"),
                             str(tmp_path / "ck"), state=True)
    got = {(r.k, int(r.window_start.timestamp()) // 10 * 10): (r.value, r.delta)
           for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {("a", 100): (5, 0), ("a", 110): (9, 4), ("b", 100): (1, 0), ("a", 5000): (9, 0),
            ("a", 5010): (12, 3), ("a", 5030): (3, 3), ("b", 5010): (1, 0), ("b", 5030): (4, 3)}
    assert {k: v for k, v in got.items() if k[1] < 99_000} == want
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_inflight_holds_plain_columns_and_tells_in_pieces(spark, tmp_path, monkeypatch):
    """Gauges over a restart, with a request without an id and a series without
    a name; the state's rows reach Python as plain columns, and a series is told
    in pieces that go on from each other."""
    seen = []
    plain = ST._carried

    def carried(rows, *rest):
        seen.append({t.simpleString().split("<")[0] for t in (f.dataType for f in rows.schema.fields)})
        return plain(rows, *rest)

    monkeypatch.setattr(ST, "_carried", carried)
    monkeypatch.setattr(ST, "TOLD_ROWS", 2)
    schema = "k string, s double, request_id long, delta int"
    one = [("a", 1.0, 7, 1), ("a", 2.0, 8, 1), ("a", 2.0, 7, -1), ("a", 13.0, None, 1), (None, 3.0, 2**60 + 1, 1)]
    two = [("a", 5001.0, 8, -1), ("a", 5002.5, 9, 1), (None, 5003.0, 2**60 + 1, -1)]
    for rows in (one, [("a", 5000.0, 3, 1)], two, [("a", 99_999.0, 1, 1)]):
        spark.createDataFrame(rows, schema).select("k", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias(
            "ts"), "request_id", "delta").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, ts timestamp, request_id long, delta int").parquet(
            str(tmp_path / "in")).withWatermark("ts", "10 minutes")
        ST.run_available_now(ST.inflight_stream(stream, ["k"]), str(tmp_path / "out"), str(tmp_path / "ck"),
                             state=True)
    got = {(r.k, round(r.ts.timestamp() * 10), r.request_id, r.delta, r.active)
           for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 10, 7, 1, 1), ("a", 20, 7, -1, 0), ("a", 20, 8, 1, 1), ("a", 130, None, 1, 2),
                   ("a", 50_000, 3, 1, 3), ("a", 50_010, 8, -1, 2), ("a", 50_025, 9, 1, 3),
                   (None, 30, 2**60 + 1, 1, 1), (None, 50_030, 2**60 + 1, -1, 0)}
    assert all(not kinds & {"array", "struct", "map"} for kinds in seen)
