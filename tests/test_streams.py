"""Streams that are stopped half-way, and go on from their checkpoints."""

import zipfile

import pytest
from pyspark.sql import functions as F

from orrery.sources import archive_stream
from orrery.streaming import feeds, weeks

SCHEMA = "event_id long, ts timestamp, iso_week string, note string"


def _write(spark, path, ids, week=lambda k: f"w{k % 2}"):
    rows = spark.createDataFrame([(k, week(k), f"n{k}") for k in ids], "event_id long, iso_week string, note string")
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("event_id") * 3600)).select("event_id", "ts", "iso_week", "note")
    rows.coalesce(1).write.mode("append").parquet(f"{path}/feed")


def _newest(ids, cap):
    return {k for w in (0, 1) for k in sorted(x for x in set(ids) if x % 2 == w)[-cap:]}


def test_keyed_cap_goes_on_from_its_checkpoint(spark, tmp_path):
    def run():
        weeks.cap_weeks(feeds.read_feed(spark, f"{tmp_path}/feed", 1, SCHEMA), 10, f"{tmp_path}/out", f"{tmp_path}/check")
        return weeks.capped_weeks(spark, f"{tmp_path}/out").collect()

    _write(spark, tmp_path, [*range(0, 60), *range(0, 5)])
    assert {r.event_id for r in run()} == _newest(range(60), 10)
    _write(spark, tmp_path, [*range(10, 20), *range(100, 103), 57])  # old ones, new ones, and one that is there
    got = run()
    assert {r.event_id for r in got} == _newest([*range(60), *range(100, 103)], 10) and len(got) == 20
    assert all(r.note == f"n{r.event_id}" and r.iso_week == f"w{r.event_id % 2}" for r in got)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_keyed_cap_repeats_a_batch_that_failed(spark, tmp_path, monkeypatch):
    """Stopped after the changes were written: the batch is run again from the same state."""
    _write(spark, tmp_path, range(40))
    args = f"{tmp_path}/out", f"{tmp_path}/check"
    weeks.cap_weeks(feeds.read_feed(spark, f"{tmp_path}/feed", 1, SCHEMA), 5, *args)
    _write(spark, tmp_path, range(50, 53))
    whole = feeds.upsert

    def stopped(target, key):
        def sink(rows, batch):
            whole(target, key)(rows, batch)
            raise RuntimeError("stopped")

        return sink

    with monkeypatch.context() as m:
        m.setattr(feeds, "upsert", stopped)
        with pytest.raises(Exception, match="stopped"):
            weeks.cap_weeks(feeds.read_feed(spark, f"{tmp_path}/feed", 1, SCHEMA), 5, *args)
    weeks.cap_weeks(feeds.read_feed(spark, f"{tmp_path}/feed", 1, SCHEMA), 5, *args)
    assert sorted(r.event_id for r in weeks.capped_weeks(spark, f"{tmp_path}/out").collect()) == sorted(_newest([*range(40), 50, 51, 52], 5))


def _zip(folder, name, members):
    folder.mkdir(exist_ok=True)
    with zipfile.ZipFile(folder / name, "w") as z:
        for m in members:
            z.writestr(f"{m}.jpg", m)


def test_each_archive_once_though_stopped_before_the_offset_is_committed(spark, tmp_path):
    """The data of a batch is there, its offset is not: the same archives are read again, others that came meanwhile are not mixed in."""
    archive_stream.register(spark)
    folder = tmp_path / "in"

    def run(fail=False):
        def sink(rows, batch):
            rows.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch}")
            if fail:
                raise RuntimeError("stopped")

        stream = spark.readStream.format("archive_arrivals").option("path", str(folder)).option("ledger", f"{tmp_path}/ledger").load()
        feeds.run(stream, sink, f"{tmp_path}/check")

    _zip(folder, "m.zip", ["a", "b"])
    run()
    _zip(folder, "k.zip", ["c"])
    with pytest.raises(Exception, match="stopped"):
        run(fail=True)
    _zip(folder, "a.zip", ["d", "e"])  # sorts before the others
    (folder / "broken.zip").write_bytes(b"nothing")
    run()
    run()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.archive_filename, r.member_path) for r in rows if r.media) == [("a.zip", "d.jpg"), ("a.zip", "e.jpg"), ("k.zip", "c.jpg"), ("m.zip", "a.jpg"), ("m.zip", "b.jpg")]
    assert [r.archive_filename for r in rows if r.error] == ["broken.zip"]
    ledger = archive_stream.Ledger(f"{tmp_path}/ledger")
    assert [p.rsplit("/", 1)[1] for p in ledger.entries()] == ["m.zip", "k.zip", "a.zip", "broken.zip"]
    assert ledger.entries(1, 3) == ledger.entries()[1:3] and ledger.append(ledger.entries()) == 4


def test_late_rows_are_put_aside_and_none_is_lost(spark, tmp_path):
    for ids in (range(100, 110), [1, 2, 105, 300], range(200, 205), [250]):
        _write(spark, tmp_path, ids)
    sink = weeks.gate(f"{tmp_path}/gate", "48 hours")

    def twice(rows, batch):  # a repeated batch finds what the first try found
        sink(rows, batch)
        sink(rows, batch)

    feeds.run(feeds.read_feed(spark, f"{tmp_path}/feed", 1, SCHEMA), twice, f"{tmp_path}/check")
    in_time, late = weeks.gated(spark, f"{tmp_path}/gate")
    assert sorted(r.event_id for r in late.collect()) == [1, 2, 200, 201, 202, 203, 204, 250]
    assert sorted(r.event_id for r in in_time.collect()) == [*range(100, 106), 105, *range(106, 110), 300]
