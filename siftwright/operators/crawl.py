"""Crawling a table of pages: links of each page, and what can be reached from a start."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.session import materialise


def resolved(link: Column, base: Column) -> Column:
    """A link of a page as an address without its fragment; null for scripts, mail and empty links."""
    plain = F.regexp_replace(F.trim(link), "#.*$", "")
    site, folder = F.regexp_extract(base, "^([a-z]+://[^/?#]*)", 1), F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "(?<=[^/:]/)[^/]*$", "")
    whole = F.when(plain.rlike("^[a-zA-Z]+://"), plain).when(plain.rlike("^//"), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), plain))
    return F.when((plain == "") | plain.rlike("^(?i)(mailto|javascript|data|tel):"), None).otherwise(F.coalesce(whole, F.when(F.startswith(plain, F.lit("/")), F.concat(site, plain)).otherwise(F.concat(folder, plain))))


def links(pages: DataFrame) -> DataFrame:
    """Distinct (url, target) of the links of pages (url, html)."""
    quoted = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"'>]*)["']"""), F.lit(1))
    each = pages.where("url IS NOT NULL").select("url", F.explode(quoted).alias("link"))
    return each.select("url", resolved(F.replace("link", F.lit("&amp;"), F.lit("&")), F.col("url")).alias("target")).where("target IS NOT NULL").distinct()


def reachable(pages: DataFrame, starts: list[str], most_steps: int | None = None) -> DataFrame:
    """url, depth and parent of pages that links lead to from the start pages: the fewest steps, and of the pages one step
    nearer the first by its address. Starts that aren't pages lead nowhere; pages that link to themselves count once.

    Each step joins the last step's pages with the links and drops what is known; links are extracted once.
    """
    known = materialise(pages.select("url").distinct())
    inside = materialise(links(pages).join(known.withColumnRenamed("url", "target"), "target", "left_semi").where("url <> target"))
    depth = 0
    frontier = materialise(known.where(F.col("url").isin(*starts)).select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))
    steps = [frontier]
    while most_steps is None or depth < most_steps:
        depth += 1
        found = frontier.select("url").join(inside, "url").groupBy(F.col("target").alias("url")).agg(F.min("url").alias("parent"))
        so_far = reduce(DataFrame.unionByName, steps).select("url")
        frontier = materialise(found.join(so_far, "url", "left_anti").select("url", F.lit(depth).alias("depth"), "parent"))
        if frontier.isEmpty():
            break
        steps.append(frontier)
    return reduce(DataFrame.unionByName, steps)
