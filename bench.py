"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default ``/root/testdata/sf0.1``) and
``BENCH_CPUS`` the cores (default 8). Each query runs once to warm up and is
then timed on a full materialization of its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from sitesignal.catalog import inputs as I  # noqa: E402
from sitesignal.catalog.queries import QUERIES  # noqa: E402
from sitesignal.operators import candidates as C  # noqa: E402
from sitesignal.session import build_session, spread, stage  # noqa: E402

HEADLINE = [
    "rank_contact_urls", "top_candidates", "robots_allowed", "sitemap_walk", "text_emails", "obfuscated_emails", "document_phones",
    "page_text", "page_emails", "site_rollup", "ranked_emails", "result_rows", "batch_summary", "fetch_outcome", "politeness_audit",
    "crawl_schedule", "hit_rate_by_window", "site_analysis",
]


def huge_host_urls(spark, sf_dir):
    """Every line item as a URL of one and the same host, as a page-URL table; written before the clock starts."""
    items = spread(I.table(spark, sf_dir, "lineitem")).select(
        F.lit("https://huge.sample.net").alias("site"), F.expr("l_orderkey * 10 + l_linenumber").alias("ord"),
        F.expr("""'https://huge.sample.net/' || CASE l_linenumber WHEN 1 THEN 'about-' || l_suppkey WHEN 2 THEN 'contact/' || l_partkey
                  ELSE 'de/community/file-' || l_orderkey || '-' || l_partkey END""").alias("url"))
    return stage(items.repartition(spark.sparkContext.defaultParallelism), "bench-urls")


def run(spark, query, sf_dir) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("sitesignal-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    todo = {name: QUERIES[name] for name in HEADLINE}
    urls = huge_host_urls(spark, sf_dir)
    todo["rank_one_huge_host"] = lambda spark, sf_dir: C.top_candidates(C.score_contact_urls(urls), ["site"])
    times = {}
    for name, query in todo.items():
        run(spark, query, sf_dir)
        times[name] = round(run(spark, query, sf_dir), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    counts = {t: I.table(spark, sf_dir, t).count() for t in ("pages", "documents", "events", "lineitem")}
    rates = {
        "urls_ranked": round(counts["lineitem"] / times["rank_one_huge_host"]),
        "pages_scanned": round(counts["pages"] / times["page_text"]),
        "documents_scanned": round(counts["documents"] / times["text_emails"]),
        "requests_audited": round(counts["events"] / times["politeness_audit"]),
    }
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "rows": counts, "per_second": rates, "cpus": cpus}))


if __name__ == "__main__":
    main()
