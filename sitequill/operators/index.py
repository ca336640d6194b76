"""The Markdown index of a site: entries, sections, quick links, the whole document."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequill.functions.basics import fallback, keep_lines, nonempty
from sitequill.functions.text import clean_text, date_display, excerpt, raise_first
from sitequill.operators.content import (
    COMMON_PAGES,
    DEFAULT_LIMIT,
    DataFrameHook,
    common_pages,
    of_types,
    published,
    ranked,
)
from sitequill.operators.scale import lookup_join, newest_first_position
from sitequill.operators.terms import term_strings

ColumnHook = Callable[[Column], Column]
LISTED = [
    "site_id",
    "post_id",
    "post_type",
    "published_at",
    "permalink",
    "author_id",
    "entry_title",
    "entry_excerpt",
]


def with_label(rows: DataFrame, type_labels: DataFrame) -> DataFrame:
    """Plural label of the type, or the type with its first letter raised."""
    labels = type_labels.select("post_type", F.col("label").alias("_label"))
    joined = lookup_join(rows, labels, ["post_type"])
    return joined.withColumn(
        "label", F.coalesce("_label", raise_first(F.col("post_type")))
    ).drop("_label")


def with_author(rows: DataFrame, authors: DataFrame) -> DataFrame:
    people = authors.select("author_id", "display_name", "archive_url")
    return lookup_join(rows, people, ["author_id"])


def listing_source(
    content: DataFrame,
    types: Sequence[str] | DataFrame,
    query_hook: DataFrameHook | None = None,
) -> DataFrame:
    """The narrow rows an index needs, with page bodies already cut to their excerpts.

    Bodies are cut in the scan, before the join that finds the allowed types, so whole pages
    never travel. A query hook sees the published rows.
    """
    rows = published(content)
    if query_hook:
        rows = query_hook(rows)
    narrow = rows.select(
        "*",
        clean_text(F.col("title")).alias("entry_title"),
        excerpt(F.col("excerpt"), F.col("content")).alias("entry_excerpt"),
    ).select(*LISTED)
    return of_types(narrow, types)


def entry_text(position: Column) -> Column:
    """One listing entry; excerpt, categories and author lines vanish when empty."""
    return keep_lines(
        F.concat(
            F.lit("### "), position.cast("string"), F.lit(". "),
            F.coalesce("entry_title", F.lit("")),
        ),
        F.lit(""),
        F.when(nonempty(F.col("entry_excerpt")), F.concat("entry_excerpt", F.lit("\n"))),
        F.concat(F.lit("- **Published:** "), date_display(F.col("published_at"))),
        F.when(nonempty(F.col("terms")), F.concat(F.lit("- **Categories:** "), "terms")),
        F.when(nonempty(F.col("display_name")), F.concat(F.lit("- **Author:** "), "display_name")),
        F.concat(
            F.lit("- **Read More:** ["), "permalink", F.lit("]("), "permalink", F.lit(")")
        ),
        F.lit(""),
    )


def _described(
    rows: DataFrame, terms: DataFrame, authors: DataFrame, type_labels: DataFrame
) -> DataFrame:
    named = rows.join(term_strings(terms), ["site_id", "post_id"], "left")
    return with_label(with_author(named, authors), type_labels)


def index_entries(
    content: DataFrame,
    terms: DataFrame,
    authors: DataFrame,
    type_labels: DataFrame,
    index_types: Sequence[str] | DataFrame,
    limit: int = DEFAULT_LIMIT,
    query_hook: DataFrameHook | None = None,
    entry_hook: ColumnHook | None = None,
) -> DataFrame:
    """Entries of the newest ``limit`` items per site, with section order and position.

    Output: site_id, post_id, label, section_order (site rank of the section's first item),
    position (1-based within the section), entry.
    """
    newest = ranked(listing_source(content, index_types, query_hook), limit)
    return entries_of(newest, terms, authors, type_labels, limit, entry_hook)


def entries_of(
    newest: DataFrame,
    terms: DataFrame,
    authors: DataFrame,
    type_labels: DataFrame,
    limit: int = DEFAULT_LIMIT,
    entry_hook: ColumnHook | None = None,
) -> DataFrame:
    """Entries of listed rows that already have their ``site_rank``; none is above the limit."""
    rows = _described(newest, terms, authors, type_labels)
    if limit < 0:
        return _unlimited_entries(rows, entry_hook)
    # A site has at most `limit` rows here, so windows over a site stay small.
    section = Window.partitionBy("site_id", "label")
    placed = rows.withColumn(
        "position", F.row_number().over(section.orderBy("site_rank"))
    ).withColumn("section_order", F.min("site_rank").over(section))
    entry = entry_text(F.col("position"))
    return placed.withColumn("entry", entry_hook(entry) if entry_hook else entry).select(
        "site_id", "post_id", "post_type", "label", "section_order", "position", "entry"
    )


def _unlimited_entries(rows: DataFrame, entry_hook: ColumnHook | None) -> DataFrame:
    placed = newest_first_position(rows, "site_id", "label", "published_at", "post_id")
    first = placed.groupBy("site_id", "label").agg(F.min("site_rank").alias("section_order"))
    placed = lookup_join(placed, first, ["site_id", "label"])
    entry = entry_text(F.col("position"))
    return placed.withColumn("entry", entry_hook(entry) if entry_hook else entry).select(
        "site_id", "post_id", "post_type", "label", "section_order", "position", "entry"
    )


def listing_rows(
    content: DataFrame,
    terms: DataFrame,
    authors: DataFrame,
    type_labels: DataFrame,
    index_types: Sequence[str] | DataFrame,
    query_hook: DataFrameHook | None = None,
    entry_hook: ColumnHook | None = None,
) -> DataFrame:
    """The index without a limit: one row per entry, never one text per site.

    Sections are ordered by their newest item; positions come from block counts, so a site
    with a third of all pages is numbered by many tasks.
    """
    source = listing_source(content, index_types, query_hook)
    rows = _described(source, terms, authors, type_labels)
    numbered = newest_first_position(rows, "site_id", "label", "published_at", "post_id")
    entry = entry_text(F.col("position"))
    return numbered.select(
        "site_id",
        "post_id",
        "label",
        "section",
        "position",
        (entry_hook(entry) if entry_hook else entry).alias("entry"),
    )


def site_facts(sites: DataFrame, settings: DataFrame) -> DataFrame:
    """Name, address, description and contact of every site; settings win over site facts."""
    chosen = settings.select("site_id", "site_description", "contact_email")
    return sites.join(chosen, "site_id", "left").select(
        "site_id",
        "site_name",
        "home_url",
        fallback(F.col("site_description"), F.col("description")).alias("description"),
        fallback(F.col("contact_email"), F.col("admin_email")).alias("contact"),
    )


def header_text() -> Column:
    return keep_lines(
        F.concat(F.lit("# "), "site_name"),
        F.lit(""),
        F.when(
            nonempty(F.col("description")),
            F.concat(F.lit("> "), F.col("description"), F.lit("\n")),
        ),
        F.concat(F.lit("> Website: "), "home_url"),
        F.concat(F.lit("> Contact: "), "contact"),
        F.lit(""),
        F.lit("---"),
        F.lit(""),
    )


def quick_links(content: DataFrame, sites: DataFrame) -> DataFrame:
    """Home and the common pages of every site, in their fixed order."""
    order = F.array_position(F.array(*[F.lit(s) for s in COMMON_PAGES]), F.col("slug"))
    links = (
        common_pages(content)
        .withColumn(
            "link", F.concat(F.lit("- ["), "title", F.lit("]("), "permalink", F.lit(")"))
        )
        .groupBy("site_id")
        .agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "link"))).alias("links"))
    )
    home = F.concat(F.lit("- [Home]("), "home_url", F.lit(")"))
    pages = F.transform(
        F.coalesce("links", F.array().cast("array<struct<o:bigint,link:string>>")),
        lambda x: x["link"],
    )
    return sites.join(links, "site_id", "left").select(
        "site_id", F.array_join(F.concat(F.array(home), pages), "\n").alias("links")
    )


def footer_text() -> Column:
    return F.concat(F.lit("---\n\n## Quick Links\n\n"), F.col("links"), F.lit("\n"))


def _sections_text(entries: Column) -> Column:
    """Entries sorted by (section, position), a heading before each section's first entry."""

    def block(e: Column) -> Column:
        heading = F.concat(F.lit("## "), e["label"], F.lit("\n\n"))
        return F.concat(
            F.when(e["position"] == 1, heading).otherwise(F.lit("")), e["entry"]
        )

    return F.array_join(F.transform(entries, block), "\n")


def site_index(
    entries: DataFrame,
    content: DataFrame,
    sites: DataFrame,
    settings: DataFrame,
    document_hook: ColumnHook | None = None,
) -> DataFrame:
    """The whole index of every site; a site without items keeps header and links.

    The gathered list is bounded by the limit that made ``entries``.
    """
    gathered = entries.groupBy("site_id").agg(
        F.sort_array(
            F.collect_list(F.struct("section_order", "position", "label", "entry"))
        ).alias("entries"),
        F.count("*").alias("items"),
    )
    rows = (
        site_facts(sites, settings)
        .join(gathered, "site_id", "left")
        .join(quick_links(content, sites), "site_id", "left")
    )
    sections = F.when(F.size("entries") > 0, _sections_text(F.col("entries")))
    document = keep_lines(header_text(), sections, footer_text())
    return rows.select(
        "site_id",
        F.coalesce("items", F.lit(0)).alias("items"),
        (document_hook(document) if document_hook else document).alias("content"),
    )
