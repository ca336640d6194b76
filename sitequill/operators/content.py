"""Selecting content: published, allowed types, newest first, point reads as joins, counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequill.functions.text import slug_normalise
from sitequill.operators.scale import lookup_join, newest_first_position, top_n

PUBLISHED = "publish"
DEFAULT_LIMIT = 500
COMMON_PAGES = ["about", "contact", "faq"]
DataFrameHook = Callable[[DataFrame], DataFrame]


def newest_first() -> list[Column]:
    return [F.desc("published_at"), F.desc("post_id")]


def published(content: DataFrame) -> DataFrame:
    return content.filter(F.col("status") == PUBLISHED)


def of_types(content: DataFrame, types: Sequence[str] | DataFrame) -> DataFrame:
    """Keep the allowed types: one list for all sites, or settings rows with a list per site."""
    if isinstance(types, DataFrame):
        allowed = types.select("site_id", F.col("post_types").alias("_types"))
        joined = lookup_join(content, allowed, ["site_id"], "inner")
        return joined.filter(F.array_contains("_types", F.col("post_type"))).drop("_types")
    return content.filter(F.col("post_type").isin(*types))


def listable_types(type_labels: DataFrame) -> DataFrame:
    """Types that a site may list: public ones other than attachments."""
    return type_labels.filter(F.col("is_public") & (F.col("post_type") != "attachment"))


def newest_published(
    content: DataFrame,
    types: Sequence[str] | DataFrame,
    limit: int = DEFAULT_LIMIT,
    query_hook: DataFrameHook | None = None,
) -> DataFrame:
    """The newest published items of every site, ranked by ``site_rank``.

    A limit below zero means all; such a site is numbered by many tasks.
    """
    rows = of_types(published(content), types)
    if query_hook:
        rows = query_hook(rows)
    return ranked(rows, limit)


def ranked(rows: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` rows of every site, or all, with their place in ``site_rank``."""
    if limit >= 0:
        return top_n(rows, ["site_id"], newest_first(), limit, "site_rank", spread_by="post_id")
    whole = rows.withColumn("_site", F.lit(0))
    numbered = newest_first_position(whole, "site_id", "_site", "published_at", "post_id")
    return numbered.withColumnRenamed("position", "site_rank").drop("_site", "section")


def newest_by_slug(content: DataFrame) -> DataFrame:
    """One published row per (site, type, slug), narrow: ``max`` combines before the shuffle."""
    return (
        published(content)
        .groupBy("site_id", "post_type", "slug")
        .agg(F.max(F.struct("published_at", "post_id", "permalink")).alias("newest"))
        .select("site_id", "post_type", "slug", "newest.post_id", "newest.permalink")
    )


def by_slug(
    lookups: DataFrame,
    content: DataFrame,
    types: Sequence[str] | DataFrame,
    query_hook: DataFrameHook | None = None,
) -> DataFrame:
    """Point reads as one join: lookups (lookup_id, site_id, post_type, slug) get a post_id.

    The type must be allowed and the slug is normalised first. No match gives null.
    """
    found = of_types(newest_by_slug(query_hook(content) if query_hook else content), types)
    wanted = lookups.withColumn("slug", slug_normalise(F.col("slug")))
    return lookup_join(wanted, found, ["site_id", "post_type", "slug"])


def by_id(
    lookups: DataFrame, content: DataFrame, types: Sequence[str] | DataFrame
) -> DataFrame:
    """Point reads by id; a draft or a type that is not allowed gives null."""
    found = of_types(
        published(content).select("site_id", "post_id", "post_type", "slug", "title"), types
    )
    return lookup_join(lookups, found, ["site_id", "post_id"])


def counts_by_type(content: DataFrame, types: Sequence[str] | DataFrame) -> DataFrame:
    """Published items per site and allowed type; allowed types without items count 0."""
    counted = (
        published(content).groupBy("site_id", "post_type").agg(F.count("*").alias("counted"))
    )
    if isinstance(types, DataFrame):
        wanted = types.select("site_id", F.explode("post_types").alias("post_type"))
    else:
        listed = F.array(*[F.lit(t) for t in types])
        wanted = (
            content.select("site_id").distinct().withColumn("post_type", F.explode(listed))
        )
    return wanted.join(counted, ["site_id", "post_type"], "left").select(
        "site_id", "post_type", F.coalesce("counted", F.lit(0)).alias("items")
    )


def total_count(content: DataFrame, types: Sequence[str] | DataFrame) -> DataFrame:
    return (
        counts_by_type(content, types)
        .groupBy("site_id")
        .agg(F.sum("items").cast("bigint").alias("items"))
    )


def common_pages(content: DataFrame) -> DataFrame:
    """The published about, contact and faq pages of every site, newest of each."""
    pages = published(content).filter(
        (F.col("post_type") == "page") & F.col("slug").isin(*COMMON_PAGES)
    )
    return (
        pages.groupBy("site_id", "slug")
        .agg(F.max(F.struct("published_at", "post_id", "title", "permalink")).alias("p"))
        .select("site_id", "slug", "p.title", "p.permalink")
    )
