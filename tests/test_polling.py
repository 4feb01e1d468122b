"""Timers over streams against their batch twin and plain loops, with late and repeated events."""

import datetime as dt
import random

from notelode.streaming.polling import due_polls, poll_stream, settled

T0 = 1_700_000_000
SCHEMA = "key long, ts timestamp, event_id long, every long"


def row(key, at, event, every=100):
    return (key, None if at is None else dt.datetime.fromtimestamp(T0 + at, dt.timezone.utc), event, every)


def run(spark, tmp_path, parts, transform):
    """The rows that a stream over files, one a trigger, gives."""
    folder, name = tmp_path / "in", f"out{random.randrange(1 << 30)}"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / f"{i:03}"))
    files = sorted(folder.glob("*/*.parquet"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for i, f in enumerate(files):
        target = flat / f"{i:03}.parquet"
        target.write_bytes(f.read_bytes())
        import os

        os.utime(target, (T0 + i, T0 + i))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(flat))
    q = transform(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name).collect()


def let_through(rows):
    out, last = [], {}
    for key, at, event, every in sorted(((k, t, e, v) for k, t, e, v in rows if k is not None and t is not None), key=lambda r: (r[0], r[1], r[2])):
        if key not in last or at >= last[key] + every:
            last[key] = at
            out.append((key, T0 + at, event))
    return sorted(out)


def test_batch_twin_equals_plain_loop(spark):
    r = random.Random(7)
    plain = [(r.choice((1, 1, 1, 2, 3)), r.randrange(5000), i, 100) for i in range(900)] + [(None, 5, 1000, 100), (4, None, 1001, 100), (5, 7, 1002, 0), (5, 7, 1003, 0)]
    rows = spark.createDataFrame([(k, None if t is None else T0 + t, e, v) for k, t, e, v in plain], "key long, at long, event_id long, every long").repartition(5)
    assert sorted(tuple(x) for x in due_polls(rows).collect()) == let_through(plain)
    assert due_polls(rows.limit(0)).count() == 0


def test_stream_lets_through_what_its_twin_does(spark, tmp_path):
    r = random.Random(8)
    plain = sorted(((r.choice((1, 2, 3)), r.randrange(3000), i, 100) for i in range(60)), key=lambda x: x[1])
    parts = [plain[i : i + 20] for i in range(0, 60, 20)]
    parts[2] = [*parts[2], parts[1][3], parts[1][3]]  # delivered again
    got = run(spark, tmp_path, [[row(*x) for x in p] for p in parts], poll_stream)
    assert sorted((x.key, x.at, x.event_id) for x in got) == let_through(plain)


def test_items_settle_or_are_given_up(spark, tmp_path):
    parts = [
        [row(1, 0, 1), row(2, 0, 2), row(3, 0, 3)],
        [row(2, 20, 4), row(3, 20, 5)],  # 1 has settled at 0; 2 and 3 have changed again
        [row(3, 40, 6), row(3, 45, 7), row(9, 300, 8)],  # 3 changes too often
        [row(9, 900, 9), row(1, 1, 10)],  # the second is late
        [row(8, 2000, 11)],
    ]
    got = run(spark, tmp_path, parts, lambda s: settled(s, gap=50, tries=3, late="10 seconds"))
    told = sorted((x.key, x.at - T0, x.changes, x.gave_up) for x in got)
    assert (1, 0, 1, False) in told and (2, 20, 2, False) in told and (3, 45, 4, True) in told and (9, 300, 1, False) in told
    assert len([x for x in told if x[0] == 1]) == 1
