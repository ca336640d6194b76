"""Terms of a post as one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible(terms: DataFrame) -> DataFrame:
    """Leave out post formats and internal taxonomies, whose names start with an underscore."""
    return terms.filter(
        (F.col("taxonomy") != "post_format") & ~F.col("taxonomy").startswith("_")
    )


def term_strings(terms: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Distinct visible names per post, first occurrence kept, joined by ", ".

    A post has few terms, so the collected list is short. With ``posts`` only the terms of
    those posts are gathered.
    """
    rows = visible(terms)
    if posts is not None:
        rows = rows.join(posts.select("site_id", "post_id"), ["site_id", "post_id"], "left_semi")
    ordered = F.sort_array(F.collect_list(F.struct("term_order", "taxonomy", "name")))
    names = F.array_distinct(F.transform(ordered, lambda t: t["name"]))
    return rows.groupBy("site_id", "post_id").agg(F.array_join(names, ", ").alias("terms"))
