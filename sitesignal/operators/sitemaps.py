"""Sitemap datasets: candidates, parsed files and the bounded walk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sitesignal import fixed_values as fv
from sitesignal.functions.files import parse_sitemap
from sitesignal.operators.skew import first_per_key, top_k
from sitesignal.session import spread, stage

FILE_STRIDE = 10_000_000_000  # page order of a site: file number * stride + position in the file


def sitemap_candidates(sites: DataFrame, declared: DataFrame | None = None, site: str = "site") -> DataFrame:
    """``(site, sitemap_url, ord)``: declared ones first, then the usual paths, each once.

    ``sites`` holds base URLs; ``declared`` holds ``(site, ord, sitemap_url)``.
    """
    guesses = sites.select(
        site,
        F.posexplode(F.array(*[F.concat(F.col(site), F.lit(p)) for p in fv.COMMON_SITEMAP_PATHS])).alias(
            "_i", "sitemap_url"
        ),
    ).select(site, "sitemap_url", (F.col("_i") + F.lit(1_000_000_000)).cast("bigint").alias("ord"))
    if declared is None:
        return guesses
    known = declared.select(site, "sitemap_url", F.col("ord").cast("bigint").alias("ord"))
    return first_per_key(known.unionByName(guesses), [site, "sitemap_url"], "ord")


def parsed_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """``(url, children, pages)`` of raw, possibly gzipped sitemap bodies."""
    parsed = spread(sitemaps.select("url", "body")).select("url", parse_sitemap("body").alias("_s"))
    return parsed.select("url", F.col("_s.children").alias("children"), F.col("_s.pages").alias("pages"))


def walk_files(seeds: DataFrame, parsed: DataFrame, site: str = "site",
               max_depth: int = fv.MAX_SITEMAP_DEPTH, max_files: int = fv.MAX_SITEMAP_FILES_PER_SITE,
               max_pages: int = fv.MAX_SITEMAP_PAGES_PER_SITE) -> DataFrame:
    """Files each site reads, in reading order, and how many pages of each count.

    Breadth-first over at most ``max_depth + 1`` waves. The frontier is one row
    per site: what it has spent, the files it has read and those it reads next,
    both at most ``max_files``. A wave joins the latter with the parsed files
    and writes the next frontier; the write itself counts the sites that go on.
    Returns ``(site, sitemap_url, file_no, take)``.
    """
    sizes = parsed.select(
        F.col("url").alias("sitemap_url"), F.size("pages").cast("bigint").alias("n"),
        # all that can still be read is among the first max_files different children
        F.slice(F.array_distinct("children"), 1, max_files).alias("children"))
    start = first_per_key(seeds.select(site, "sitemap_url", F.col("ord").cast("bigint").alias("ord")), [site, "sitemap_url"], "ord")
    start = top_k(start, [site], [F.col("ord"), F.col("sitemap_url")], max_files, rank="_i")
    frontier = start.groupBy(site).agg(F.array_sort(F.collect_list(F.struct("_i", "sitemap_url"))).alias("_next")).select(
        site, F.lit(0).cast("bigint").alias("spent"), F.array().cast("array<string>").alias("seen"),
        F.col("_next.sitemap_url").alias("next"))
    waves = []
    for depth in range(max_depth + 1):
        wanted = frontier.filter(F.size("next") > 0)
        listed = wanted.select(site, F.posexplode("next").alias("_i", "sitemap_url")).join(sizes, "sitemap_url", "left")
        files = listed.groupBy(site).agg(F.array_sort(F.collect_list(F.struct("_i", "sitemap_url", "n", "children"))).alias("files"))
        done = _read_wave(wanted.join(files, site), site, max_files, max_pages)
        going_on = Observation()
        frontier = stage(done.observe(going_on, F.count_if(F.size("next") > 0).alias("sites")), f"sitemap-wave{depth}")
        waves.append(frontier.select(site, F.explode("read").alias("_r")).select(site, "_r.*"))
        if going_on.get["sites"] == 0:
            break
    return reduce(DataFrame.unionByName, waves)


def _read_wave(rows: DataFrame, site: str, max_files: int, max_pages: int) -> DataFrame:
    """``(site, spent, seen, next, read)`` after the files of a wave, which ``files`` holds in reading order."""
    none = F.array().cast("array<bigint>")

    def take(state: Column, file: Column) -> Column:
        n = F.least(F.coalesce(file["n"], F.lit(0).cast("bigint")), F.lit(max_pages).cast("bigint") - state["spent"])
        return F.struct((state["spent"] + n).alias("spent"), F.concat(state["takes"], F.array(n)).alias("takes"))

    # the names differ from those of the result, or a lambda would see the new columns in place of the old
    counted = rows.select(site, F.col("seen").alias("_seen"), "files", F.aggregate(
        "files", F.struct(F.col("spent"), none.alias("takes")), take).alias("_c"))
    read = F.transform("files", lambda f, i: F.struct(
        f["sitemap_url"].alias("sitemap_url"), (F.size("_seen") + i + 1).cast("bigint").alias("file_no"),
        F.get("_c.takes", i).alias("take")))
    seen = F.concat("_seen", F.col("files.sitemap_url"))
    named = F.flatten(F.transform("files", lambda f: F.coalesce(f["children"], F.array().cast("array<string>"))))
    fresh = F.slice(F.array_except(named, seen), F.lit(1), F.lit(max_files) - F.size(seen))
    return counted.select(
        site, F.col("_c.spent").alias("spent"), seen.alias("seen"),
        F.when(F.col("_c.spent") < max_pages, fresh).otherwise(F.array().cast("array<string>")).alias("next"), read.alias("read"))


def walk_leftovers(seeds: DataFrame, parsed: DataFrame, files: DataFrame, site: str = "site") -> DataFrame:
    """``(site, files_left, pages_left)``: what the budgets and the depth of a walk left out.

    ``files`` is the result of ``walk_files``. Files are counted once a site,
    if a seed or a file it has read names them; pages are those of files read.
    """
    read = files.join(parsed.select(F.col("url").alias("sitemap_url"), "children", F.size("pages").alias("n")), "sitemap_url", "left")
    pages = read.groupBy(site).agg(F.sum(F.coalesce("n", F.lit(0)) - F.col("take")).alias("pages_left"))
    known = seeds.select(site, "sitemap_url").unionByName(read.select(site, F.explode("children").alias("sitemap_url"))).distinct()
    unread = known.join(files.select(site, "sitemap_url"), [site, "sitemap_url"], "left_anti")
    left = unread.groupBy(site).agg(F.count(F.lit(1)).alias("files_left"))
    return pages.join(left, site, "left").select(site, F.coalesce("files_left", F.lit(0)).alias("files_left"), "pages_left")


def walk_sitemaps(seeds: DataFrame, parsed: DataFrame, site: str = "site", **limits: int) -> DataFrame:
    """``(site, url, ord)`` of every page the walk collects, repeats included."""
    files = walk_files(seeds, parsed, site, **limits).filter("take > 0")
    pages = files.join(parsed.select(F.col("url").alias("sitemap_url"), "pages"), "sitemap_url")
    rows = pages.select(
        site, "file_no", F.posexplode(F.slice("pages", F.lit(1), F.col("take").cast("int"))).alias("_i", "url"))
    return rows.select(site, "url", (F.col("file_no") * F.lit(FILE_STRIDE) + F.col("_i")).alias("ord"))


def dedupe_pages(pages: DataFrame, site: str = "site") -> DataFrame:
    """Each URL of a site once, at its first position."""
    return first_per_key(pages, [site, "url"], "ord")
