from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitesignal.operators import captures as C
from sitesignal.plans.analyze import signals_for
from sitesignal.session import fits_broadcast, stage
from sitesignal.sources.tables import write_captures

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def captured(spark):
    """Two thirds of the rows are captures of one URL."""
    rows = [("https://a.io/hot" if i % 3 else f"https://a.io/{i}#part", f"<p>v{i}@a.io</p>", 200, START + timedelta(seconds=(i * 37) % 1000), "static") for i in range(300)]
    return spark.createDataFrame(rows, "url string, html string, status int, fetched_at timestamp, pass string")


def wanted(spark, *keys):
    return stage(spark.createDataFrame([(k,) for k in keys], "key string"), "wanted")


def test_newest_capture_wins(spark, captured):
    rows = captured.collect()
    newest = max((r for r in rows if r.url.endswith("hot")), key=lambda r: r.fetched_at)
    got = {r.key: r.emails for r in signals_for(wanted(spark, "https://a.io/hot", "https://a.io/0", "https://a.io/none"), C.keyed(captured)).collect()}
    assert got == {"https://a.io/hot": [newest.html[3:-4]], "https://a.io/0": ["v0@a.io"]}


def test_both_join_forms_agree(spark, captured, monkeypatch):
    keys = wanted(spark, *[f"https://a.io/{i}" for i in range(0, 300, 6)], "https://a.io/hot")
    small = sorted(map(str, C.latest_matching(C.keyed(captured), keys).collect()))
    monkeypatch.setattr(C, "fits_broadcast", lambda *a: False)
    assert sorted(map(str, C.latest_matching(C.keyed(captured), keys).collect())) == small and len(small) == 51


def test_broadcast_bound(spark):
    keys = stage(spark.range(1000).select(F.repeat(F.lit("k"), 1000).alias("key")), "same")  # tiny as a file, 1 MB in memory
    assert fits_broadcast(keys, "key") and not fits_broadcast(keys, "key", limit=500_000)


def test_bucketed_captures_are_not_shuffled(spark, captured, monkeypatch):
    write_captures(captured, "captures_by_key", buckets=4)
    monkeypatch.setattr(C, "fits_broadcast", lambda *a: False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = C.latest_matching(C.keyed(spark.table("captures_by_key")), wanted(spark, "https://a.io/hot"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # below each exchange, only the wanted keys are read
    lines = plan.splitlines()
    depth = lambda s: len(s) - len(s.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "Exchange" in line:
            below = []
            for other in lines[i + 1:]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            assert not any("captures_by_key" in x for x in below)
