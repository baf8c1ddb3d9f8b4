"""Streams give what the batch forms give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticeframe.operators import changes as batch_changes
from noticeframe.operators import state
from noticeframe.streaming import changes, telemetry, upsert


@pytest.fixture
def state_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    changes.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def ran(stream, name, at, mode="append"):
    """Rows of a stream run to its end, batch by batch."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(at)).start()
    q.awaitTermination(240)
    return stream.sparkSession.table(name), q


def test_stream_upsert_equals_batches(spark, tmp_path, state_store):
    t = dt.datetime(2026, 1, 1)
    schema = "id long, fp string, at timestamp, n int"
    day = dt.timedelta(1)
    batches = [[(1, "a", t, 1), (2, "b", t, 1), (2, "z", t, 0)], [(1, "a", t + day, 1), (2, "c", t + day, 1)], [(2, "b", t, 1), (4, None, t, 1)], [(2, "d", t + 3 * day, 1), (3, "e", t + day, 1)]]
    known = spark.createDataFrame([], "id long, fp string, first_seen_at timestamp, updated_at timestamp, revision int")
    for b in batches:
        df = spark.createDataFrame(b, schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        late = known.select(F.col("id").alias("k"), F.col("updated_at").alias("u"))
        fresh = df.join(late, (df.id == late.k) & (df["at"] <= late.u), "left_anti")
        known = state.upsert(known, fresh, "id", "fp", "at", "n").drop("outcome")
    out, _ = ran(upsert.upsert_stream(upsert.file_stream(spark, str(tmp_path / "in"), schema), "id", "fp", "at", "n"), "upserts", tmp_path / "check", "update")
    last = {r.id: (r.fp, r.first_seen_at, r.updated_at, r.revision) for r in sorted(out.collect(), key=lambda r: r.revision)}
    assert last == {r.id: (r.fp, r.first_seen_at, r.updated_at, r.revision) for r in known.where("fp IS NOT NULL").collect()}
    assert last[2][3] == 3 and [r.outcome for r in out.where("id = 1").orderBy("outcome").collect()] == ["new", "unchanged"]


def version_rows(seed=1, n=200, keys=12):
    import random

    r, t = random.Random(seed), dt.datetime(2026, 1, 1)
    days = [f"2026-01-0{d}" for d in range(1, 9)] + ["2026-03-01", "soon", None, "2026-13-01"]
    return [
        (
            r.randrange(keys), t + dt.timedelta(hours=6 * i), i, r.choice(["招聘", "补录招聘", "笔试通知", "延期公告"]), r.choice(["正文内容一二三四五\n待遇优厚五险一金", "正文", None, "正文内容一二三四五\n请投递简历至邮箱"]),
            r.choice(["", "2026-05-01", "2026-06-01", None]), r.choice([0, 3, 5, None]), r.choice([["a"], ["a", "b"], None, []]), r.choice([["济南"], ["济南", "青岛"], [], None]),
            r.choice(["", "https://x/1", "https://x/campus/detail?jobAdId=ab-1"]), r.choice([["简章"], ["简章", "岗位表"], []]), r.choice(["", "本科", "硕士"]), r.choice([None, "仅核实"]), "招聘" if i % 17 else "宣讲会", r.choice(days),
        )
        for i in range(n)
    ]


VERSIONS = "k long, ts timestamp, n long, title string, body string, deadline string, position_count int, majors array<string>, cities array<string>, application_url string, attachments array<string>, education string, note string, kind string, published_at string"


def test_change_stream_equals_batch(spark, tmp_path, state_store):
    rows = version_rows()
    for part in range(4):
        spark.createDataFrame(rows[50 * part : 50 * part + 50], VERSIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = changes.version_stream(upsert.file_stream(spark, str(tmp_path / "in"), VERSIONS), "k", "ts", "n")
    columns = ["k", "n", "published", "first_seen", "revision"]
    out, q = ran(changes.with_change(stream, "ts").select(*columns, "change"), "changed", tmp_path / "c1")
    log = spark.createDataFrame(rows, VERSIONS)
    batch = batch_changes.change_log(log, "k", "ts", "n").select(*columns, "change")
    plain = lambda df: sorted(str(r) for r in df.collect())
    assert plain(out) == plain(batch) and out.count() > 150
    # The state grows by key: as many rows as keys, whatever the number of versions.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 12
    every, _ = ran(stream.select(*columns), "versions", tmp_path / "c2")
    assert plain(every) == plain(batch_changes.version_pairs(log, "k", "ts", "n").select(*columns))


def test_late_and_repeated_versions_give_nothing(spark, tmp_path, state_store):
    t = dt.datetime(2026, 1, 5)
    row = lambda at, n, title: (1, at, n, title, *[None] * 11)
    for b in ([row(t, 1, "招聘")], [row(t, 1, "招聘"), row(t - dt.timedelta(1), 9, "补录")], [row(t + dt.timedelta(1), 1, "补录")]):
        spark.createDataFrame(b, VERSIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, _ = ran(changes.version_stream(upsert.file_stream(spark, str(tmp_path / "in"), VERSIONS), "k", "ts", "n").select("n", "revision", "changed", "new.title"), "late", tmp_path / "c")
    assert sorted(map(tuple, out.collect())) == [(1, 1, True, "招聘"), (1, 2, True, "补录")]


def test_listing_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    rows = [("a", t, False, True), ("a", t + dt.timedelta(hours=7), False, True), ("b", t, True, True)]
    schema = "k string, ts timestamp, seen boolean, complete boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = upsert.listing_stream(upsert.file_stream(spark, str(tmp_path / "in"), schema), "k").writeStream.format("memory").queryName("listing").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    batch = state.listing_status(spark.createDataFrame(rows, schema), "k", "ts", "seen", "complete")
    assert {tuple(r) for r in spark.table("listing").collect()} == {tuple(r) for r in batch.collect()}


def test_telemetry(spark):
    df = spark.createDataFrame([(1, "click", 1.0, '{"k": 3}'), (2, "nope", 1.0, "{}"), (3, "error", -1.0, "{}"), (4, "error", 2.0, "x")], "event_id long, event_type string, value double, props string")
    assert [(r.event_id, r.payload.k if r.payload else None) for r in telemetry.valid(df).collect()] == [(1, 3), (4, None)]
    status = spark.range(1).select(telemetry.verdict(F.lit("{}"), F.lit("text/plain"), F.lit("click"))).first()[0]
    assert status == 415
