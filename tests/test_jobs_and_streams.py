import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitesignal import fixed_values as fv
from sitesignal.operators.extraction import page_signals
from sitesignal.operators.rollup import categorize, flatten_result
from sitesignal.plans.analyze import analyze, apply_rendered_pass
from sitesignal.plans.batch import run_batch
from sitesignal.sources import sinks, tables
from sitesignal.streaming import streams

CAPTURES = "url string, html string, status int, pass string"
CASES = [
    ("https://shop.io/contact", '<title>Contact</title><a href="mailto:Sales@shop.io?x">m</a> <p>info@partner.org</p>', 200),
    ("https://shop.io/", "home", 200),
    ("https://fall.io", '<title>Home</title><meta name="Description" content=" Desc "><footer><a href="/kontakt">K</a><a href="/private/contact">p</a></footer>', 200),
    ("https://fall.io/kontakt", '<p>Call +1 (555) 123-4567</p><a href="https://www.instagram.com/mybrand/">i</a>', 200),
    ("https://fall.io/private/contact", "hidden@fall.io", 200),
    ("https://blocked.io", "Access Denied Reference #1", 403),
    ("https://hop.io", '<title>Hop</title><a href="/team">Team</a><a href="/blog/x">b</a><a href="/a/b/c">deep</a>', 200),
    ("https://hop.io/team", "jane@hop.io", 200),
    ("https://fail.io/", "x", 500),
    ("https://fail.io/contact", "x", 500),
    ("https://plain.io", "nothing here", 200),
]
ROBOTS = [("shop.io", "User-agent: *\nDisallow: /private\nSitemap: https://shop.io/sm.xml"), ("fall.io", "User-agent: *\nDisallow: /private/")]
SITEMAPS = [
    ("https://shop.io/sm.xml", b'<sitemapindex xmlns="x"><sitemap><loc>https://shop.io/sm2.xml</loc></sitemap></sitemapindex>'),
    ("https://shop.io/sm2.xml", b"<urlset><url><loc>https://shop.io/contact</loc></url><url><loc>https://shop.io/private/contact</loc></url></urlset>"),
    ("https://fail.io/sitemap.xml", b"<urlset><url><loc>https://fail.io/contact</loc></url></urlset>"),
]
TARGETS = ["shop.io", "https://shop.io/x", "fall.io", "dead.io", "", "blocked.io", "hop.io", "fail.io", "plain.io", "shop.io"]


@pytest.fixture(scope="module")
def world(spark):
    rendered = [("https://plain.io", "<p>hi@plain.io</p>", 200, "rendered")]
    return {
        "targets": spark.createDataFrame([(t,) for t in TARGETS], "input_url string"),
        "captures": spark.createDataFrame([(*c, "static") for c in CASES] + rendered, CAPTURES),
        "robots": spark.createDataFrame(ROBOTS, "host string, body string"),
        "sitemaps": spark.createDataFrame([(u, bytearray(b)) for u, b in SITEMAPS], "url string, body binary"),
    }


@pytest.fixture(scope="module")
def results(world):
    return categorize(analyze(**world)).cache()


def by_url(df):
    return {r.input_url: r for r in df.collect()}


def test_every_way_a_site_ends(results):
    r = by_url(results)
    assert set(r) == set(TARGETS)
    assert (r["shop.io"].method, r["shop.io"].emails, r["shop.io"].mailto_emails, r["shop.io"].pages_checked) == (
        "sitemap", ["info@partner.org", "sales@shop.io"], ["sales@shop.io"], ["https://shop.io/contact"])
    assert r["https://shop.io/x"].emails == r["shop.io"].emails
    fall = r["fall.io"]
    assert (fall.method, fall.category, fall.phones, fall.page_title, fall.meta_description) == (
        "homepage-fallback", "salvage_only", ["+1 (555) 123-4567"], "Home", "Desc")
    assert fall.error == fv.ERROR_NO_EMAILS and fall.pages_checked[:2] == ["https://fall.io", "https://fall.io/kontakt"]
    assert (r["dead.io"].method, r["dead.io"].error) == ("none", fv.ERROR_UNREACHABLE)
    assert (r[""].method, r[""].error, r[""].category) == ("", fv.ERROR_UNPARSEABLE, "connection_failed")
    assert (r["blocked.io"].method, r["blocked.io"].blocked_by, r["blocked.io"].error) == ("none", "akamai", fv.ERROR_NO_PAGES)
    assert (r["hop.io"].emails, r["hop.io"].source_pages, r["hop.io"].pages_checked) == (
        ["jane@hop.io"], ["https://hop.io/team"], ["https://hop.io", "https://hop.io/team"])
    assert (r["fail.io"].fetch_failed, r["fail.io"].method, r["fail.io"].category) == (True, "sitemap", "connection_failed")
    assert r["plain.io"].category == "genuine_no_result"


def test_robots_can_be_ignored(world):
    r = by_url(analyze(**{**world, "respect_robots": False}))
    assert r["fall.io"].emails == ["hidden@fall.io"]


def test_mx_runs_after_status_and_before_salvage(spark, world):
    mx = spark.createDataFrame([("hop.io", False), ("partner.org", False)], "domain string, has_mx boolean")
    r = by_url(analyze(**world, mx=mx))
    assert r["shop.io"].emails == ["sales@shop.io"]
    assert (r["hop.io"].emails, r["hop.io"].fetch_failed, r["hop.io"].error) == ([], False, fv.ERROR_NO_EMAILS)


def test_personal_addresses_can_be_dropped(world):
    r = by_url(analyze(**world, drop_personal=True))
    assert r["hop.io"].emails == [] and r["shop.io"].emails == ["info@partner.org", "sales@shop.io"]


def test_rendered_pass(results, world):
    r = by_url(apply_rendered_pass(results.drop("category").filter("input_url in ('plain.io', 'fail.io', 'shop.io', 'dead.io')"), world["captures"]))
    assert (r["plain.io"].emails, r["plain.io"].method, r["plain.io"].error) == (["hi@plain.io"], "homepage-fallback+playwright", "")
    assert (r["shop.io"].method, r["shop.io"].emails) == ("sitemap+playwright", ["info@partner.org", "sales@shop.io"])
    assert r["fail.io"].fetch_failed and r["fail.io"].error.startswith("pages failed to fetch")
    assert r["dead.io"].error == fv.ERROR_UNREACHABLE


def test_rendered_inside_the_main_pass(world):
    r = by_url(analyze(**world, use_rendered=True))
    assert r["plain.io"].emails == ["hi@plain.io"] and r["shop.io"].method == "sitemap"


def test_invariants(results):
    flat = by_url(flatten_result(results))
    for url, r in by_url(results).items():
        f = flat[url]
        every = [e for c in (f.own_domain_emails, f.other_domain_emails) for e in c.split("; ") if e]
        assert sorted(every) == sorted(r.emails) and (f.primary_email in every or not every)
        assert r.category in fv.CATEGORIES and len(r.pages_checked) <= fv.MAX_PAGES_PER_SITE + fv.MAX_SECOND_HOP_LINKS


def test_batch_resume_retry_history(spark, world, tmp_path):
    out, history = str(tmp_path / "run"), str(tmp_path / "history")
    some = world["targets"].filter("input_url in ('shop.io', 'fail.io', 'plain.io')")
    later = world["captures"].unionByName(spark.createDataFrame([("https://fail.io/contact", "help@fail.io", 200, "static")], CAPTURES)).filter(
        "not (url = 'https://fail.io/contact' and status = 500)")
    inputs = {k: v for k, v in world.items() if k != "targets"}
    final = by_url(run_batch(some, output_path=out, retry_captures=later, history_path=history, **inputs))
    assert final["fail.io"].emails == ["help@fail.io"] and final["plain.io"].emails == ["hi@plain.io"]
    assert {r.input_url for r in tables.read_completed(spark, out + "/final").collect()} == {"shop.io", "fail.io", "plain.io"}
    with pytest.raises(FileExistsError):
        run_batch(some, output_path=out, **inputs)
    again = by_url(run_batch(world["targets"], output_path=out, resume=True, history_path=history, **inputs))
    assert set(again) == set(TARGETS) - {"shop.io", "fail.io", "plain.io"}
    rows = by_url(tables.read_results_csv(spark, out + "/final"))
    assert set(rows) - {None} == set(TARGETS) - {""} and rows["fail.io"].primary_email == "help@fail.io"
    log = tables.read_history(spark, history).collect()
    assert [r.total for r in log] == [3, 6] and log[0].email_found == 3


def test_files(spark, tmp_path):
    path = tmp_path / "targets.txt"
    path.write_text("# list\n\n shop.io , note\nhttps://a.org/x\n   \n#x\n")
    assert sorted(r.input_url for r in tables.read_targets(spark, str(path)).collect()) == ["https://a.org/x", "shop.io"]
    assert tables.read_completed(spark, str(tmp_path / "none")).count() == 0 and tables.read_history(spark, str(tmp_path / "none")).count() == 0
    log = tmp_path / "history.jsonl"
    log.write_text("".join(json.dumps({"timestamp": f"2024-01-0{i}T00:00:00+00:00", "total": i}) + "\n" for i in range(1, 6)) + "{broken\n\n")
    assert [r.total for r in tables.read_history(spark, str(log), 2).collect()] == [4, 5]


def test_captures_table_and_bytes(spark, tmp_path):
    raw = spark.createDataFrame([("https://a.io", bytearray(b"ok \xff"), 200), ("https://b.io", bytearray(b"no"), 500)], "url string, body binary, status int")
    raw.write.parquet(str(tmp_path / "c"))
    got = {r.url: (r.text, r.block_text) for r in tables.usable_text(tables.read_captures(spark, str(tmp_path / "c"))).collect()}
    assert got == {"https://a.io": ("ok �", "ok �"), "https://b.io": (None, "no")}


def test_job_key(spark):
    import hashlib
    urls = ["b.io", "a.io", "c.io"]
    hashes = [hashlib.sha1(u.encode()).hexdigest() for u in urls]
    sums = [sum(int(h[8 * i:8 * i + 8], 16) for h in hashes) for i in range(5)]
    want = hashlib.sha1(",".join(map(str, sums)).encode()).hexdigest()[:16]
    key = lambda us: sinks.job_key(spark.createDataFrame([(u,) for u in us], "input_url string")).first().job_key
    assert key(urls) == key(urls[::-1]) == want
    assert key(urls + ["a.io"]) != want


def test_stream_extract_equals_batch(spark, tmp_path):
    captures = spark.createDataFrame([(u, h, s, datetime(2024, 1, 1)) for u, h, s in CASES], "url string, html string, status int, fetched_at timestamp")
    captures.write.parquet(str(tmp_path / "in"))
    stream = streams.stream_extract(spark.readStream.schema(captures.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(str, page_signals(captures, keep=["url", "fetched_at"]).collect()))


def result_stream(spark, tmp_path, batches, schema):
    """A file stream with one file per batch."""
    os.makedirs(tmp_path / "src")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))


def test_stream_upsert_and_recent(spark, tmp_path):
    schema = "input_url string, error string, seq bigint, finished_at timestamp"
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    batches = [[("a", "old", 1, at(1)), ("b", "x", 2, at(2))], [("a", "new", 1, at(3))]]
    source = result_stream(spark, tmp_path, batches, schema)
    streams.stream_upsert_results(source, str(tmp_path / "up"), str(tmp_path / "cp1")).awaitTermination()
    assert {(r.input_url, r.error) for r in streams.read_upserted(spark, str(tmp_path / "up")).collect()} == {("a", "new"), ("b", "x")}
    compact = str(tmp_path / "compact")
    streams.compact_upserts(spark, str(tmp_path / "up"), 1, compact)
    assert spark.read.parquet(f"{compact}/part-*").count() == 2
    streams.upsert_writer(compact)(spark.createDataFrame([("b", "newer", 1, at(4))], schema), 2)
    assert {(r.input_url, r.error) for r in streams.read_upserted(spark, compact).collect()} == {("a", "new"), ("b", "newer")}
    q = source.writeStream.foreachBatch(streams.recent_writer(str(tmp_path / "recent"), n=2)).option("checkpointLocation", str(tmp_path / "cp2"))
    q.trigger(availableNow=True).start().awaitTermination()
    assert [r.error for r in streams.read_recent(spark, str(tmp_path / "recent")).collect()] == ["new", "x"]
    for i in (2, 3):
        streams.recent_writer(str(tmp_path / "recent"), n=2)(spark.createDataFrame([("c", f"e{i}", i, at(i + 5))], schema), i)
    assert sorted(x for x in os.listdir(tmp_path / "recent") if x.startswith("snap-")) == [f"snap-{i:020d}" for i in (2, 3)]
    assert [r.error for r in streams.read_recent(spark, str(tmp_path / "recent")).collect()] == ["e3", "e2"]


def test_stream_counters(spark, tmp_path):
    schema = "emails array<string>, error string"
    source = result_stream(spark, tmp_path, [[(["a@b.io"], ""), ([], "e")], [([], "e")]], schema)
    q = streams.stream_counters(source).writeStream.outputMode("complete").format("memory").queryName("counters")
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert tuple(spark.table("counters").first()) == (3, 1, 2)


def test_windows_on_stream_and_table(spark, tmp_path):
    rows = [[(datetime(2024, 1, 1, h, m), h % 2 == 0, m == 0)] for h in range(6) for m in (0, 30)]
    schema = "ts timestamp, hit boolean, failed boolean"
    source = result_stream(spark, tmp_path, rows, schema)
    q = streams.hit_rate_windows(source).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
    q.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    batch = {tuple(r) for r in streams.hit_rate_windows(spark.createDataFrame(sum(rows, []), schema)).collect()}
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got < batch and len(got) == 5  # the last window is still open


def test_stream_give_up(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    batches = [[("stuck", "started", at(0)), ("fine", "started", at(0))], [("fine", "finished", at(60))], [("late", "started", at(400))], [("late", "finished", at(410))]]
    source = result_stream(spark, tmp_path, batches, "input_url string, kind string, at timestamp")
    q = streams.stream_give_up(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
    q.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.input_url, r.method) for r in rows] == [("stuck", "none")] and rows[0].error.startswith("gave up after 180s")


def test_give_up_by_clock(spark, tmp_path):
    """Started, finished and late rows, and a start before a restart from the checkpoint; no row comes after the last start."""
    at = datetime(2024, 1, 1)
    folder, out = tmp_path / "progress", str(tmp_path / "out")

    def run(n, rows, seconds):
        spark.createDataFrame([(u, k, at) for u, k in rows], "input_url string, kind string, at timestamp").coalesce(1).write.parquet(str(folder / f"b{n}"))
        source = spark.readStream.schema("input_url string, kind string, at timestamp").parquet(str(folder / "b*"))
        with streams.rocksdb_state(spark):
            writer = streams.stream_give_up_by_clock(source, seconds).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
            streams.run_until_idle(writer.start(out))

    given_up = lambda: sorted(r.input_url for r in spark.read.schema(streams.GIVE_UP_OUTPUT).parquet(out).collect())
    run(0, [("fine", "started"), ("fine", "finished"), ("slow", "started"), ("odd", "other")], 3600)
    assert given_up() == []
    run(1, [("stuck", "started"), ("slow", "finished")], 0)  # restarted: slow is still open and finishes, stuck is given up at once
    assert given_up() == ["stuck"]
    run(2, [("fine", "started"), ("stuck", "started"), ("new", "started"), ("new", "started")], 0)  # late rows do not open a closed target
    assert given_up() == ["new", "stuck"]


def test_until_idle_raises_where_the_output_is_not_whole(spark, tmp_path):
    """By the clock a query is never done, so it has to be told apart from one that was cut off."""
    rows = [("stuck", "started")]
    spark.createDataFrame(rows, "input_url string, kind string").write.parquet(str(tmp_path / "progress/b0"))
    source = lambda: spark.readStream.schema("input_url string, kind string").parquet(str(tmp_path / "progress/b*"))

    def start(n):
        with streams.rocksdb_state(spark):
            writer = streams.stream_give_up_by_clock(source(), 0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"cp{n}"))
            return writer.start(str(tmp_path / f"out{n}"))

    query = start(0)
    with pytest.raises(TimeoutError, match="not whole"):
        streams.run_until_idle(query, timeout_seconds=0)
    assert not query.isActive
    query = start(1)
    query.stop()
    with pytest.raises(RuntimeError, match="before it was idle"):
        streams.run_until_idle(query)


def test_until_idle_reads_past_files_without_rows(spark, tmp_path):
    """Four batches of an empty file each come before the one with rows."""
    schema = "input_url string, kind string"
    for n, rows in enumerate([[], [], [], [], [("stuck", "started")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"progress/b{n}"))
        for part in (tmp_path / f"progress/b{n}").glob("part-*"):
            os.utime(part, (1_700_000_000 + n, 1_700_000_000 + n))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "progress/b*"))
    with streams.rocksdb_state(spark):
        writer = streams.stream_give_up_by_clock(source, 0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        streams.run_until_idle(writer.start(str(tmp_path / "out")))
    assert [r.input_url for r in spark.read.schema(streams.GIVE_UP_OUTPUT).parquet(str(tmp_path / "out")).collect()] == ["stuck"]


def test_line_numbers_over_files_and_blocks(spark, tmp_path):
    lines = [f"site{i}.io, x" if i % 3 else "# none" for i in range(500)]
    for k in range(4):
        (tmp_path / f"part{k}.txt").write_text("\n".join(lines[125 * k:125 * (k + 1)]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # many blocks to a file
    try:
        got = {r.ord: r.input_url for r in tables.read_target_list(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i + 1: f"site{i}.io" for i in range(500) if i % 3}


def test_resume_from_a_result_file(spark, world, tmp_path):
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    inputs = {k: world[k] for k in ("captures", "robots", "sitemaps") if k in world}
    done = run_batch(world["targets"].limit(1), output_path=first, **inputs)
    rest = run_batch(world["targets"], output_path=second, completed_path=f"{first}/final", **inputs)
    had = {r.input_url for r in done.select("input_url").collect()}
    want = {r.input_url for r in world["targets"].select("input_url").collect()} - had
    assert had and {r.input_url for r in rest.select("input_url").collect()} == want


def test_retry_queue(spark, results):
    once = spark.createDataFrame([("dead.io",)], "input_url string")
    assert sorted(r.input_url for r in streams.stream_retry_queue(results, once).collect()) == ["fail.io"]
