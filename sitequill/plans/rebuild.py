"""Render artefacts: everything once, then only what changes or expiry make stale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sitequill.functions.markup import safe_markup
from sitequill.functions.text import item_key, listing_key
from sitequill.operators import changes as ch
from sitequill.operators.content import newest_by_slug, of_types, published
from sitequill.operators.detail import page_documents
from sitequill.operators.index import index_entries, site_index
from sitequill.operators.routing import INDEX_PATH, ITEM_PATH
from sitequill.operators.scale import lookup_join
from sitequill.plans.tables import Tables
from sitequill.session import cut_lineage
from sitequill.sources.artifacts import append_artifacts, artifacts_of_batch, read_artifacts
from sitequill.sources.tables import write_events


def render_items(
    tables: Tables, content: DataFrame, now: Column, wanted: DataFrame | None = None
) -> DataFrame:
    """Item artefacts for the given content rows, or those of ``wanted`` (site_id, post_id)."""
    pages = page_documents(
        content, tables.terms, tables.authors, tables.media, tables.sites, wanted=wanted
    )
    ttl = tables.settings.select("site_id", F.col("item_ttl_s").alias("ttl_s"))
    return lookup_join(pages, ttl, ["site_id"]).select(
        "site_id",
        item_key(F.col("post_type"), F.col("slug")).alias("artifact_key"),
        F.lit("item").alias("kind"),
        "content",
        now.alias("generated_at"),
        F.coalesce("ttl_s", F.lit(ch.ITEM_TTL_S).cast("bigint")).alias("ttl_s"),
        F.md5("content").alias("source_hash"),
    )


def render_listings(tables: Tables, site_ids: DataFrame | None, now: Column) -> DataFrame:
    """Index artefacts of the given sites, or of all."""

    def keep(rows: DataFrame) -> DataFrame:
        return rows if site_ids is None else rows.join(site_ids, "site_id", "left_semi")

    content = keep(tables.content)
    entries = index_entries(
        content, tables.terms, tables.authors, tables.type_labels, tables.settings
    )
    documents = site_index(entries, content, keep(tables.sites), tables.settings)
    facts = tables.settings.select("site_id", "post_types", F.col("index_ttl_s").alias("ttl_s"))
    return documents.join(facts, "site_id").select(
        "site_id",
        listing_key(F.col("post_types")).alias("artifact_key"),
        F.lit("listing").alias("kind"),
        "content",
        now.alias("generated_at"),
        "ttl_s",
        F.md5("content").alias("source_hash"),
    )


def render_all(tables: Tables, path: str, now: Column, batch: str | int = 0) -> None:
    """First run: every page and every index."""
    # One post per slug: of posts that share a slug only the newest can be reached.
    tables = tables.plain()
    newest = of_types(newest_by_slug(tables.content), tables.settings)
    items = render_items(
        tables, published(tables.content), now, newest.select("site_id", "post_id")
    )
    listings = render_listings(tables, None, now)
    append_artifacts(items.unionByName(listings), path, batch)


def keys_of(tables: Tables, changes: DataFrame, artifacts: DataFrame | None, now: Column) -> DataFrame:
    """The artefact keys that changes make stale and, of stored artefacts, the expired ones."""
    stale = ch.stale_keys(changes, tables.content, tables.settings)
    keys = stale if artifacts is None else ch.keys_to_rebuild(stale, ch.expired(artifacts, now))
    return cut_lineage(keys, "stale-keys")


def rebuilt(
    tables: Tables,
    changes: DataFrame,
    artifacts: DataFrame | None,
    now: Column,
    keys: DataFrame | None = None,
    item_hook: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """New artefact rows for one batch of changes, removed ones as rows without content.

    Stored ``artifacts`` add the expired ones, and limit removals to keys that are stored.
    Without them, as on a stream, every stale key that has no live source gets such a row.
    ``keys`` may be given if they are known; ``item_hook`` changes the content rows before items
    are looked up.
    """
    if keys is None:
        keys = keys_of(tables, changes, artifacts, now)
    # From here on only the touched sites are read.
    touched = cut_lineage(keys.select("site_id").distinct(), "touched-sites")
    tables = tables.touched(touched)
    found = item_hook(tables.content) if item_hook else tables.content
    narrow = found.select("site_id", "post_id", "post_type", "slug", "status", "published_at", "permalink")
    live = cut_lineage(ch.live_items(narrow.join(touched, "site_id", "left_semi"), tables.settings), "live-items")
    wanted = cut_lineage(ch.wanted_items(live, keys), "wanted-items")
    items = render_items(tables, tables.content.join(wanted, ["site_id", "post_id"], "left_semi"), now, wanted)
    sites = keys.filter(F.col("kind") == "listing").select("site_id").distinct()
    fresh = items.unionByName(render_listings(tables, sites, now))
    # A key that is stale but has no published, allowed source any more is removed.
    listings = tables.settings.select("site_id", listing_key(F.col("post_types")).alias("artifact_key"))
    alive = live.select("site_id", "artifact_key").unionByName(listings)
    gone = keys.join(alive, ["site_id", "artifact_key"], "left_anti")
    if artifacts is not None:
        stored = artifacts.select("site_id", "kind", "artifact_key")
        gone = gone.join(stored, ["site_id", "kind", "artifact_key"], "left_semi")
    return fresh.unionByName(ch.tombstones(gone, now))


def rebuild_stored(
    tables: Tables, changes: DataFrame, path: str, now: Column, batch: str | int, events: str | None = None
) -> None:
    """Batch job: render what changes and expiry make stale in the stored artefacts.

    With ``events`` the job leaves rows there: before and after, what it invalidated, wrote and
    removed per site and kind, and, if it ends early, that it failed.
    """
    spark = changes.sparkSession
    stored = read_artifacts(spark, path)
    keys = keys_of(tables, changes, stored, now)
    if events is None:
        append_artifacts(rebuilt(tables, changes, stored, now, keys), path, batch)
        return
    gone, total = F.col("content").isNull(), Observation("rebuilt")
    started = _job_event(spark, "before", 0, now).unionByName(_counted(keys, "invalidated", F.lit(True), now))
    write_events(started, events, f"{batch}-before")
    try:
        rows = rebuilt(tables, changes, stored, now, keys)
        append_artifacts(rows.observe(total, F.count_if(~gone).alias("written"), F.count_if(gone).alias("removed")), path, batch)
    except Exception as error:
        write_events(_job_event(spark, "failed", 0, now, str(error)[:500]), events, f"{batch}-after")
        raise
    done = total.get
    made = artifacts_of_batch(spark, path, batch)
    ended = (
        _job_event(spark, "after", done["written"] + done["removed"], now)
        .unionByName(_counted(made, "written", ~gone, now))
        .unionByName(_counted(made, "removed", gone, now))
    )
    write_events(ended, events, f"{batch}-after")


def _counted(rows: DataFrame, event: str, which: Column, now: Column) -> DataFrame:
    """One event row per site and kind, counted on the map side."""
    return rows.filter(which).groupBy("site_id", "kind").agg(F.count("*").alias("n")).select(
        "site_id", "kind", F.lit(event).alias("event"), "n", now.cast("timestamp").alias("at"), F.lit(None).cast("string").alias("message")
    )


def _job_event(spark: SparkSession, event: str, n: int, now: Column, message: str | None = None) -> DataFrame:
    """A row about the job as a whole."""
    return spark.range(1).select(
        F.lit(None).cast("string").alias("site_id"), F.lit("job").alias("kind"), F.lit(event).alias("event"),
        F.lit(n).cast("bigint").alias("n"), now.cast("timestamp").alias("at"), F.lit(message).cast("string").alias("message"),
    )


def served_documents(pages: DataFrame, indexes: DataFrame) -> DataFrame:
    """Page and index texts as they go out, one row per address: (site_id, path, content).

    HTML that is left in the Markdown passes the allow-list here and not before, so stored
    artefacts keep their text.
    """
    path = F.concat(F.lit(ITEM_PATH), "post_type", F.lit("/"), "slug")
    return pages.select(
        "site_id", path.alias("path"), safe_markup(F.col("content")).alias("content")
    ).unionByName(
        indexes.select(
            "site_id",
            F.lit(INDEX_PATH).alias("path"),
            safe_markup(F.col("content")).alias("content"),
        )
    )


def served_pages(pages: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Texts under page addresses, one row each: (site_id, path, content).

    ``pages`` has one document per (site_id, post_type, slug). An override text (site_id,
    route_page, content) goes before the page; an empty one says that there is no page, a
    null one that there is no override.
    """
    rows = pages.filter(F.col("post_type") == "page").select("site_id", F.col("slug").alias("page"), "content")
    if overrides is not None:
        fixed = overrides.filter(F.col("content").isNotNull()).select(
            "site_id", F.col("route_page").alias("page"), F.col("content").alias("fixed")
        )
        rows = rows.join(fixed, ["site_id", "page"], "full").select(
            "site_id", "page", F.coalesce("fixed", "content").alias("content")
        )
    return rows.filter(F.col("content") != "").select(
        "site_id",
        F.concat(F.lit(ITEM_PATH), "page").alias("path"),
        safe_markup(F.col("content")).alias("content"),
    )


def clear_kind(
    artifacts: DataFrame, prefix: str, path: str, now: Column, batch: str, events: str | None = None
) -> None:
    """Remove all artefacts whose key starts with ``prefix``; the counts go to ``events``."""
    append_artifacts(ch.tombstones(ch.of_kind(artifacts, prefix), now), path, batch)
    if events is not None:
        made = artifacts_of_batch(artifacts.sparkSession, path, batch)
        write_events(_counted(made, "cleared", F.lit(True), now), events, f"{batch}-cleared")


def read_events(spark: SparkSession, events: str) -> DataFrame:
    """All event rows: site_id, kind, event, n, at, message; rows about a job have no site."""
    return spark.read.parquet(f"{events}/run=*")


def summary(batch_rows: DataFrame) -> DataFrame:
    """Job summary per site and kind: artefacts written and removed."""
    gone = F.col("content").isNull()
    return batch_rows.groupBy("site_id", "kind").agg(
        F.count_if(~gone).alias("written"), F.count_if(gone).alias("removed")
    )
