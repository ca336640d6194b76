"""The listing of every site kept up to date: a stored top list that follows the change feed.

A stored list has the newest ``limit + margin`` listed rows of every site, with their excerpts,
and says whether the site has more. Changes take rows out and put rows in; content is read again
only for the posts that changed, and for sites that have used up their margin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequill.operators.content import DEFAULT_LIMIT, DataFrameHook, newest_first
from sitequill.operators.index import LISTED, listing_source
from sitequill.operators.scale import lookup_join, top_n
from sitequill.session import cut_lineage

DEFAULT_MARGIN = 100


def _place() -> Column:
    """A row's place as a value: the larger, the earlier in the listing."""
    return F.struct("published_at", "post_id")


def _first(rows: DataFrame, keep: int, more: Column) -> DataFrame:
    # One row beyond the list tells whether the site has more; windows see `keep + 1` rows a site.
    top = top_n(rows, ["site_id"], newest_first(), keep + 1, "site_rank", spread_by="post_id")
    beyond = F.max("site_rank").over(Window.partitionBy("site_id")) > keep
    return top.withColumn("more", more | beyond).filter(F.col("site_rank") <= keep).select(*LISTED, "site_rank", "more")


def first_rows(
    content: DataFrame,
    types: Sequence[str] | DataFrame,
    limit: int = DEFAULT_LIMIT,
    margin: int = DEFAULT_MARGIN,
    query_hook: DataFrameHook | None = None,
) -> DataFrame:
    """The list to store: the newest ``limit + margin`` rows of every site.

    Output: the listed columns, ``site_rank``, and ``more``: the site has rows beyond the list.
    """
    return _first(listing_source(content, types, query_hook), limit + margin, F.lit(False))


def followed(
    stored: DataFrame,
    feed: DataFrame,
    content: DataFrame,
    types: Sequence[str] | DataFrame,
    limit: int = DEFAULT_LIMIT,
    margin: int = DEFAULT_MARGIN,
    query_hook: DataFrameHook | None = None,
    again: DataFrame | None = None,
) -> DataFrame:
    """The stored list after the changes of the feed, in the same form.

    ``feed`` names posts (site_id, post_id) that came, went or differ; ``content`` is the state
    after them. Where a site has more rows than the list, all that stand at its last row or
    before are known, so a changed post enters there and is left out behind it. A site with
    fewer than ``limit`` known rows is filled from the content, as are the sites (site_id) in
    ``again``: those whose allowed types changed, which no post tells.
    """
    touched = cut_lineage(feed.select("site_id", "post_id").distinct(), "touched-posts")
    ends = stored.filter("more").groupBy("site_id").agg(F.min(_place()).alias("end"))
    fresh = listing_source(content.join(touched, ["site_id", "post_id"], "left_semi"), types, query_hook)
    fresh = lookup_join(fresh.select(*LISTED), ends, ["site_id"])
    fresh = fresh.filter(F.col("end").isNull() | (_place() >= F.col("end")))
    kept = stored.join(touched, ["site_id", "post_id"], "left_anti").select(*LISTED, "more")
    known = cut_lineage(
        kept.unionByName(fresh.select(*LISTED, F.col("end").isNotNull().alias("more"))), "known-rows"
    )
    counts = known.groupBy("site_id").agg(F.count("*").alias("n"))
    short = ends.join(counts, "site_id", "left").filter(F.coalesce("n", F.lit(0)) < limit).select("site_id")
    if again is not None:
        short = short.unionByName(again.select("site_id")).distinct()
    short = cut_lineage(short, "short-sites")
    whole = known.join(short, "site_id", "left_anti")
    filled = first_rows(content.join(short, "site_id", "left_semi"), types, limit, margin, query_hook)
    return _first(whole, limit + margin, F.col("more")).unionByName(filled)
