from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from sitesignal.operators.rollup import latest_per_target
from sitesignal.streaming import state_tables as T

T0 = datetime(2024, 1, 3, tzinfo=timezone.utc)
ROW = "input_url string, seq bigint, note string, finished_at timestamp"


def stream_of(spark, path, batches):
    """Each call of the returned function lets one more batch arrive."""
    arriving = iter(batches)

    def arrive():
        spark.createDataFrame(next(arriving), ROW).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(ROW).parquet(path)

    return arrive


BATCHES = [
    [("a", 5, "five", T0), ("b", 1, None, None), ("a", 2, "two", T0 + timedelta(microseconds=3))],
    [("a", 4, "late", T0 + timedelta(seconds=9)), ("c", 7, "", T0), ("c", 7, "", T0)],
    [("b", 9, "nine", T0 + timedelta(days=1)), (None, 3, "nameless", T0 - timedelta(days=1))],
]


def test_latest_from_state_over_restarts(spark, tmp_path):
    arrive = stream_of(spark, str(tmp_path / "in"), BATCHES)
    for n in range(3):  # a restart each time
        rows = arrive()
        T.keep_latest(rows, str(tmp_path / "c")).awaitTermination()
        want = latest_per_target(spark.createDataFrame(sum(BATCHES[:n + 1], []), ROW))
        got = T.read_latest(spark, str(tmp_path / "c"), rows.schema)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_counters_from_state(spark, tmp_path):
    arrive = stream_of(spark, str(tmp_path / "in"), BATCHES)
    for _ in BATCHES:
        results = arrive().select(F.when(F.col("input_url") == "b", F.array(F.lit("x"))).when(
            F.col("note") == "late", F.array(F.lit("y"))).otherwise(F.array().cast("array<string>")).alias("emails"), F.coalesce("note", F.lit("")).alias("error"))
        T.keep_counters(results.withColumn("error", F.when(F.col("error") == "", F.lit("")).otherwise("e")), str(tmp_path / "c")).awaitTermination()
    got = tuple(T.read_counters(spark, str(tmp_path / "c")).first())
    everything = sum(BATCHES, [])
    assert got == (len(everything), sum(r[0] == "b" or r[2] == "late" for r in everything), sum(bool(r[2]) for r in everything))


def test_newest_from_state_over_restarts(spark, tmp_path):
    arrive = stream_of(spark, str(tmp_path / "in"), BATCHES)
    for n in range(3):
        rows = arrive()
        T.keep_newest(rows, str(tmp_path / "c"), n=4, parts=3).awaitTermination()
        got = [(r.input_url, r.seq, r.note, r.finished_at) for r in T.read_newest(spark, str(tmp_path / "c"), rows.schema, n=4).collect()]
        times = sorted((r[3] for r in sum(BATCHES[:n + 1], []) if r[3]), reverse=True)
        shown = [r[3].astimezone(timezone.utc) for r in got if r[3]]
        assert shown == times[:4] and len(got) == min(4, len(sum(BATCHES[:n + 1], [])))
    assert [r[0] for r in got] == ["b", "a", "a", "c"]


def test_tables_in_folders_are_streamed_whole(spark, tmp_path):
    """Each table once as a file and once as a folder of part files, which a filter on the table's name would pass over."""
    from sitesignal.catalog import queries as Q

    events = [(i, T0.replace(tzinfo=None) + timedelta(seconds=i), i % 3, ("view", "click", "error")[i % 3]) for i in range(9)]
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", None), (2, 0, "user", None)]
    pages = [(i, f"https://www.a{i}.example.com/x", f"<p>Hello {i}</p>") for i in range(12)]
    tables = {"events": (events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"),
              "conversations": (turns, "conv_id bigint, turn int, role string, text string"),
              "pages": (pages, "page_id bigint, url string, html string")}
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        df.repartition(3).write.parquet(str(tmp_path / "folders" / f"{name}.parquet"))
        df.coalesce(1).write.parquet(str(tmp_path / "written" / name))
        (part,) = (tmp_path / "written" / name).glob("part-*.parquet")
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / f"{name}.parquet").write_bytes(part.read_bytes())
    for query in (Q.upserted_targets, Q.streamed_counters, Q.newest_results, Q.streamed_emails, Q.given_up_targets):
        one, many = [sorted(map(str, query(spark, str(tmp_path / kind)).collect())) for kind in ("files", "folders")]
        assert one == many and one, query.__name__
