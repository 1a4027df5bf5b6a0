"""A breadth-first crawl over a link table, a level at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.config import Settings
from skein.session import Tables


def is_relevant(title: Column, settings: Settings | None = None) -> Column:
    """No excluded prefix or suffix, and some keyword, whatever its case."""
    s = settings or Settings()
    either = lambda cs: reduce(lambda a, b: a | b, cs, F.lit(False))
    bad = either([F.startswith(title, F.lit(p)) for p in s.excluded_prefixes]) | either([F.endswith(title, F.lit(p)) for p in s.excluded_suffixes])
    return ~bad & either([F.contains(F.lower(title), F.lit(k.lower())) for k in s.seed_keywords])


def crawl(links: DataFrame, seeds: DataFrame, max_depth: int = 2, max_pages: int | None = None, relevant: Column | None = None) -> DataFrame:
    """title, depth, place of what a crawl visits; its order is (depth, place).

    links: title, pos, target. seeds: title. A title is visited at its least depth, placed after the
    page that named it first; seeds are always relevant. Pages within the budget come first in that
    order, and the budget is applied a level at a time, so later levels start from visited pages. A place is the path of
    link positions from the seed, so no level is numbered in one task.
    """
    ok = relevant if relevant is not None else F.lit(True)
    saved = Tables(links.sparkSession).written
    level = saved(seeds.select("title").distinct().select("title", F.lit(0).alias("depth"), F.array(F.struct(F.lit(0).alias("pos"), F.col("title").alias("title"))).alias("place")), "crawl")
    visited, left = level, max_pages
    for depth in range(max_depth + 1):
        if left is not None:
            level = level.orderBy("place").limit(left)
            left -= level.count()
        visited = level if depth == 0 else visited.unionByName(level)
        if depth == max_depth or left is not None and left <= 0:
            break
        named = level.select(F.col("title").alias("_from"), "place").join(links, F.col("_from") == F.col("title")).select(F.col("target").alias("title"), F.concat("place", F.array(F.struct(F.col("pos").cast("int").alias("pos"), F.col("target").alias("title")))).alias("place"))
        fresh = named.join(visited.select("title"), "title", "left_anti").groupBy("title").agg(F.min("place").alias("place")).where(ok)
        level = saved(fresh.select("title", F.lit(depth + 1).alias("depth"), "place"), "crawl")
    return visited
