"""One Markdown document per page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequill.functions.basics import keep_lines, nonempty
from sitequill.functions.html import html_to_markdown
from sitequill.functions.text import clean_text, date_display
from sitequill.operators.index import with_author
from sitequill.operators.scale import lookup_join
from sitequill.operators.terms import term_strings

ColumnHook = Callable[[Column], Column]


def _bold(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- **{label}:** "), value)


def _link(text: str, url: str) -> Column:
    return F.concat(F.lit("["), F.col(text), F.lit("]("), F.col(url), F.lit(")"))


def document_text() -> Column:
    image = F.concat(
        F.lit("## Featured Image\n\n!["), F.coalesce("image_alt", F.lit("")), F.lit("]("),
        F.col("image_url"), F.lit(")\n"),
    )
    return keep_lines(
        F.concat(F.lit("# "), F.coalesce("clean_title", F.lit(""))),
        F.lit(""),
        F.when(nonempty(F.col("body")), F.concat("body", F.lit("\n"))),
        F.lit("---\n\n## Details\n"),
        _bold("Published", date_display(F.col("published_at"))),
        _bold("Last Updated", date_display(F.col("modified_at"))),
        F.when(
            nonempty(F.col("display_name")),
            _bold("Author", _link("display_name", "archive_url")),
        ),
        F.when(nonempty(F.col("terms")), _bold("Categories", F.col("terms"))),
        _bold("Permalink", _link("permalink", "permalink")),
        F.lit(""),
        F.when(F.col("image_url").isNotNull(), image),
        F.lit("---"),
        F.lit(""),
        F.concat(F.lit("*From "), _link("site_name", "home_url"), F.lit("*")),
    )


def page_documents(
    content: DataFrame,
    terms: DataFrame,
    authors: DataFrame,
    media: DataFrame,
    sites: DataFrame,
    content_hook: ColumnHook | None = None,
    document_hook: ColumnHook | None = None,
    strict: bool = True,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Documents (site_id, post_id, post_type, slug, content) for the given content rows.

    ``wanted`` (site_id, post_id) restricts them. Terms, image, author and site are found for
    narrow rows first. The body becomes Markdown in the scan stage and meets those details in
    one join, so it travels at most once and the page's HTML never does.
    """
    html = content_hook(F.col("content")) if content_hook else F.col("content")
    pages = content.select(
        "site_id",
        "post_id",
        "post_type",
        "slug",
        "published_at",
        "modified_at",
        "permalink",
        clean_text(F.col("title")).alias("clean_title"),
        html_to_markdown(html, strict).alias("body"),
    )
    post = ["site_id", "post_id"]
    details = content.select(*post, "author_id")
    if wanted is not None:
        details = details.join(wanted, post, "left_semi")
    sides = media.select(*post, "image_url", "image_alt")
    details = details.join(term_strings(terms, wanted), post, "left").join(sides, post, "left")
    names = sites.select("site_id", "site_name", "home_url")
    details = lookup_join(with_author(details, authors), names, ["site_id"]).drop("author_id")
    rows = pages.join(details, post)
    text = document_text()
    return rows.select(
        "site_id",
        "post_id",
        "post_type",
        "slug",
        (document_hook(text) if document_hook else text).alias("content"),
    )
