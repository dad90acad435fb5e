"""State with timers: the stream's sessions equal those of the whole table, whatever the order of its input."""

import datetime as dt
import random

import pytest
from weftline.streaming import flows, sessions

SCHEMA = "event_id long, user_id long, ts timestamp, value double"
START = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, files, gap="30 minutes", late="2 hours"):
    """The sessions that a stream of these files gives, a file at a time; the stream is stopped and taken up again on the way."""
    folder, out = str(tmp_path / "in"), []
    schema = spark.createDataFrame([], SCHEMA).schema
    with sessions.state_store(spark):
        for part in (files[: len(files) // 2], files[len(files) // 2 :]):
            for rows in part:
                spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
                stream = sessions.closed_sessions(flows.subscribe(spark, folder, schema, files=1), gap, late)
                flows.run_available(stream, lambda df, _: out.extend(tuple(r) for r in df.collect()), str(tmp_path / "ck"))
    return sorted((u, n, a, z, k, round(t, 6)) for u, n, a, z, k, t in out)


def whole(spark, rows, gap="30 minutes", late=None):
    out = sessions.batch_sessions(spark.createDataFrame(rows, SCHEMA), gap, late).collect()
    return sorted((u, n, a, z, k, round(t, 6)) for u, n, a, z, k, t in (tuple(r) for r in out))


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_equal_the_batch(spark, tmp_path, seed):
    """Shuffled within the watermark's delay, and with repeated rows."""
    rnd = random.Random(seed)
    events, at = [], 0
    for i in range(150):
        at += rnd.choice([30, 300, 900, 1700, 1800, 2500, 4000])
        events.append((i, rnd.randint(1, 4), START + dt.timedelta(seconds=at), float(rnd.randint(0, 9))))
    end = (999, 9, events[-1][2] + dt.timedelta(days=1), 0.0)  # moves the watermark past all
    delayed = sorted([*events, *rnd.sample(events, 40)], key=lambda e: e[2] + dt.timedelta(seconds=rnd.randint(0, 5000)))
    files = [delayed[i : i + 50] for i in range(0, len(delayed), 50)] + [[end]]
    got = run(spark, tmp_path, files)
    assert got == whole(spark, events)
    assert got == [s for s in whole(spark, [*delayed, end], late="2 hours") if s[0] != 9]


def test_late_and_odd_rows(spark, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    files = [[(1, 1, at(0), 1.0), (None, 1, at(10), None), (None, 1, at(10), 2.0), (3, 1, None, 5.0)], [(4, 2, at(600), 1.0)], [(5, 1, at(5), 9.0), (6, 2, at(601), 1.0)], [(7, 3, at(2000), 0.0)]]
    assert run(spark, tmp_path, files) == [(1, 1, at(0), at(10), 3, 3.0), (2, 1, at(600), at(601), 2, 2.0)]


def test_runs_meet():
    assert sessions.merged([(50, 60, 2, 1.0), (0, 10, 1, 1.0), (19, 45, 1, 1.0)], 10) == [(0, 60, 4, 3.0)]
    assert sessions.merged([(0, 10, 1, 1.0), (20, 20, 1, 1.0)], 10) == [(0, 10, 1, 1.0), (20, 20, 1, 1.0)]
