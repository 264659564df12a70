"""Each named query against its SQL, at the smallest scale."""

import datetime
import os

import duckdb
import pytest

from framewright.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())
    assert got and got == want


@pytest.mark.parametrize("channels", [65535, 65536, 70000])
def test_dense_frames_of_many_channels_equal_sql(spark, tmp_path, channels):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_minutes(CAST(i % 150 AS INT)) AS ts, i % {channels} AS user_id, CAST(i * 37 % 101 AS DOUBLE) AS value FROM range(90000) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = catalog.queries()["dense_spike_frames"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.select("bin_start", "samples", "bytes").collect())
    want = sorted(con.execute(f"SELECT bin_start, samples, bytes FROM ({catalog.oracle_sql()['dense_spike_frames']})").fetchall())
    assert [(b, n, len(s)) for b, s, n in got] == [(b, n, len(s)) for b, s, n in want]
    assert len(got) == 3 and got == want


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from framewright.operators.frames import detect_and_bin
    from framewright.streaming.spikes import stream_packets, write_stream

    start = datetime.datetime(2024, 1, 1)
    data = [(start + datetime.timedelta(milliseconds=7 * i), i % 6, float(2000 + (i * 37) % 100)) for i in range(100)]
    df = spark.createDataFrame(data, "ts timestamp, channel long, v double")
    late = spark.createDataFrame([(start + datetime.timedelta(seconds=60), 0, 0.0)], "ts timestamp, channel long, v double")
    df.union(late).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = write_stream(stream_packets(stream, 2048, "25 milliseconds", 6), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r.bin_start: (list(r.samples), r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    bins = df.select(F.window("ts", "25 milliseconds")["start"].alias("bin_start"))
    batch = detect_and_bin(df, 2048, "25 milliseconds", bins, spark.range(6).select(F.col("id").alias("channel")))
    want = {r.bin_start: (list(r.samples), 0) for r in batch.collect()}
    assert got and got == {k: v for k, v in want.items() if k in got} and len(want) - len(got) <= 1


def test_packet_files_and_cursors(spark, tmp_path):
    from pyspark.sql import functions as F

    from framewright.operators import codecs
    from framewright.sources import packets as P

    df = codecs.encode(spark.createDataFrame([(1, [1, 2, 3])], "frame_id long, samples array<int>"), "rice").drop("samples")
    P.write_packets(df, str(tmp_path / "p"))
    back = P.read_packets(spark, str(tmp_path / "p"))
    p = F.col("packet")
    r = back.select(P.byte_at(p, 4), P.take_bytes(p, 0, 4)[0], P.take_bytes(p, 0, 400)[1], P.byte_at(p, 400), F.length(P.remaining(p, 8)), P.within_budget(p, 5)).first()
    assert r[0] == 1 and bytes(r[1]) == b"PHDC" and r[2] == -6 and r[3] is None and r[4] > 0 and r[5] == -1


def test_packet_buffers(spark):
    from pyspark.sql import functions as F

    from framewright.sources import packets as P

    empty, ab = F.unhex(F.lit("")), F.unhex(F.lit("0102"))
    one = P.append_bytes(empty, ab, 3)
    r = spark.range(1).select(
        F.hex(one["packet"]), P.append_bytes(one["packet"], ab, 3)["status"], P.room(one["packet"], 3), F.hex(P.split_at(ab, 1)["head"]), F.hex(P.split_at(ab, 1)["tail"]),
        P.split_at(ab, 3)["status"], F.hex(P.split_at(ab, 2)["tail"]), P.append_bytes(F.lit(None).cast("binary"), ab, 3)["status"],
    ).first()
    assert tuple(r) == ("0102", -1, 1, "01", "02", -6, "", None)
