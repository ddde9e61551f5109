import datetime as dt

from siftgate.streaming import events


def _write(spark, d, rows):
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp").repartition(3, "event_id").write.parquet(f"{d}/events.parquet")


def test_windows_over_many_batches_equal_one_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    _write(spark, tmp_path, [(i, i % 5, "ab"[i % 2], i / 4, t + dt.timedelta(minutes=7 * i)) for i in range(200)])
    one, many = (sorted(events.settled(events.windows(events.source(spark, str(tmp_path), n))).collect()) for n in (None, 1))
    assert one == many and sum(r.n for r in one) == 200


def test_sessions_end_after_a_gap_and_empty_input_has_none(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    _write(spark, tmp_path, [(i, 1, "a", 1.0, t + dt.timedelta(minutes=m)) for i, m in enumerate((0, 10, 50, 60))])
    assert sorted(r.n for r in events.settled(events.sessions(events.source(spark, str(tmp_path)))).collect()) == [2, 2]
    _write(spark, tmp_path / "none", [])
    assert events.settled(events.windows(events.source(spark, str(tmp_path / "none")))).count() == 0
