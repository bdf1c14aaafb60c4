"""Sessions over ranges of time against one pass in order."""

import datetime
import random

import pytest

from notelake.operators import state

START = datetime.datetime(2024, 1, 1)


def one_pass(rows, gap):
    out = []
    for ts, path in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if out and ts < out[-1][1]:
            out[-1][1] = ts + gap
            out[-1][2].add(path)
        else:
            out.append([ts, ts + gap, {path}])
    return [(a, b, sorted(p - {None})) for a, b, p in out]


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("spacing", [1, 9, 40, 10_000])
def test_sessions_equal_one_pass(spark, spacing, parts):
    draw = random.Random(spacing)
    rows = [(START + datetime.timedelta(seconds=draw.randint(0, 100 * spacing)), draw.choice(["a", "b", "c", None])) for _ in range(200)] + [(None, "n")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        made = state.coalesce_changes(spark.createDataFrame(rows, "ts timestamp, path string"), "path", "10 seconds").collect()
        plan = state.coalesce_changes(spark.createDataFrame(rows, "ts timestamp, path string"), "path", "10 seconds")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.start, r.end, r.paths) for r in made) == one_pass(rows, datetime.timedelta(seconds=10))
    assert "session_window" not in plan
