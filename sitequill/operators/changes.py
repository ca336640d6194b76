"""Incremental rebuild: which artefacts a change makes stale, which expired, what to render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequill.functions.text import item_key, listing_key
from sitequill.operators.content import newest_by_slug, of_types
from sitequill.operators.scale import lookup_join

# Lifetimes in seconds.
ITEM_TTL_S = 600
LISTING_TTL_S = 3600
MISSING_TTL_S = 300


def relevant(changes: DataFrame) -> DataFrame:
    """Changes that matter: no autosaves or revisions; a transition must cross "publish"."""
    crosses = (F.col("old_status") != F.col("new_status")) & (
        (F.col("old_status") == "publish") | (F.col("new_status") == "publish")
    )
    return changes.filter(
        ~F.col("is_autosave")
        & ~F.col("is_revision")
        & ((F.col("event") != "transition") | crosses)
    )


def changed_posts(changes: DataFrame, content: DataFrame) -> DataFrame:
    """Addresses (post_type, slug) of posts with a relevant change, each once.

    Changes may carry ``post_type`` and ``slug``, as a deletion should, since the content no longer
    has them, and as a move does for the address that was left. Busy posts collapse map-side.
    """
    known = content.select("site_id", "post_id", "post_type", "slug")
    post = ["site_id", "post_id"]
    if not {"post_type", "slug"} <= set(changes.columns):
        return relevant(changes).select(*post).distinct().join(known, post)
    told = relevant(changes).select(*post, "post_type", "slug").distinct()
    found = told.select(*post).distinct().join(known, post)
    return found.unionByName(told.dropna(subset=["post_type", "slug"])).distinct()


def stale_keys(changes: DataFrame, content: DataFrame, settings: DataFrame) -> DataFrame:
    """Three keys per changed address: the item by id, the item by slug, the site's listing."""
    posts = lookup_join(
        changed_posts(changes, content),
        settings.select("site_id", "post_types"),
        ["site_id"],
    )
    kind = lambda name, key: F.struct(F.lit(name).alias("kind"), key.alias("artifact_key"))
    keys = F.array(
        kind("item", item_key(F.col("post_type"), F.col("post_id"))),
        kind("item", item_key(F.col("post_type"), F.col("slug"))),
        kind("listing", listing_key(F.col("post_types"))),
    )
    return (
        posts.select("site_id", F.explode(keys).alias("k"))
        .select("site_id", "k.kind", "k.artifact_key")
        .distinct()
    )


def _state(content: DataFrame, name: str) -> DataFrame:
    """One narrow row per post: address, status and a digest of all else, taken in the scan."""
    rest = [c for c in content.columns if c not in ("site_id", "post_id", "post_type", "slug", "status")]
    digest = F.struct(F.xxhash64(*rest).alias("a"), F.xxhash64(F.lit("second"), *reversed(rest)).alias("b"))
    rows = content.select("site_id", "post_id", F.struct("post_type", "slug", "status", digest.alias("digest")).alias("s"))
    return rows.groupBy("site_id", "post_id").agg(F.max("s").alias(name))


def snapshot_changes(before: DataFrame, after: DataFrame, at: Column) -> DataFrame:
    """The change feed that leads from one snapshot of the content to another.

    A post that came or differs gives a save, one that went a delete, one whose status differs a
    transition as well; one with a new address gives a delete of the address it left. Rows carry
    ``post_type`` and ``slug``. Bodies are compared by 128 bits of hash and never shuffled; the
    snapshots meet in one join on the post. Of rows that share a post one counts.
    """
    joined = _state(before, "old").join(_state(after, "new"), ["site_id", "post_id"], "full")
    old, new = F.col("old"), F.col("new")
    came, went = old.isNull(), new.isNull()
    moved = (old["post_type"] != new["post_type"]) | (old["slug"] != new["slug"])
    kept = ~came & ~went

    def event(name: str, of: Column, when: Column) -> Column:
        row = F.struct(
            F.lit(name).alias("event"), of["post_type"].alias("post_type"), of["slug"].alias("slug"),
            old["status"].alias("old_status"), new["status"].alias("new_status"),
        )
        return F.when(F.coalesce(when, F.lit(False)), row)

    events = F.array_compact(F.array(
        event("save", new, came | (kept & ((old["digest"] != new["digest"]) | moved))),
        event("transition", new, kept & (old["status"] != new["status"])),
        event("delete", old, went | (kept & moved)),
    ))
    return joined.select("site_id", "post_id", F.explode(events).alias("e")).select(
        "site_id", "post_id", at.cast("timestamp").alias("ts"), "e.*",
        F.lit(False).alias("is_autosave"), F.lit(False).alias("is_revision"),
    )


def expired(artifacts: DataFrame, now: Column) -> DataFrame:
    """Artefacts whose lifetime is over at ``now``."""
    return artifacts.filter(
        F.unix_seconds("generated_at") + F.col("ttl_s") <= F.unix_seconds(now)
    )


def of_kind(artifacts: DataFrame, prefix: str, keep: bool = True) -> DataFrame:
    """Artefacts whose key starts with ``prefix``, or the others with ``keep=False``."""
    matches = F.col("artifact_key").startswith(prefix)
    return artifacts.filter(matches if keep else ~matches)


def keys_to_rebuild(stale: DataFrame, old: DataFrame) -> DataFrame:
    columns = ["site_id", "kind", "artifact_key"]
    return stale.select(*columns).unionByName(old.select(*columns)).distinct()


def live_items(content: DataFrame, settings: DataFrame) -> DataFrame:
    """One published, allowed post per item key, on narrow columns: site_id, post_id, artifact_key."""
    return of_types(newest_by_slug(content), settings).select(
        "site_id", "post_id", item_key(F.col("post_type"), F.col("slug")).alias("artifact_key")
    )


def wanted_items(live: DataFrame, keys: DataFrame) -> DataFrame:
    """The posts (site_id, post_id) of those live items whose key is stale or expired."""
    items = keys.filter(F.col("kind") == "item").select("site_id", "artifact_key")
    return live.join(items, ["site_id", "artifact_key"], "left_semi").select("site_id", "post_id")


def items_to_rebuild(content: DataFrame, settings: DataFrame, keys: DataFrame) -> DataFrame:
    """Published, allowed content whose artefact is stale or expired, one post per key.

    A scan of narrow columns finds the posts; bodies are read only for those.
    """
    return content.join(wanted_items(live_items(content, settings), keys), ["site_id", "post_id"], "left_semi")


def cleared_counts(artifacts: DataFrame) -> DataFrame:
    """How many artefacts each site would lose per kind."""
    return artifacts.groupBy("site_id", "kind").agg(F.count("*").alias("cleared"))


def tombstones(keys: DataFrame, now: Column) -> DataFrame:
    """Artefact rows without content: readers see the key as removed."""
    return keys.select(
        "site_id",
        "artifact_key",
        "kind",
        F.lit(None).cast("string").alias("content"),
        now.cast("timestamp").alias("generated_at"),
        F.lit(MISSING_TTL_S).cast("bigint").alias("ttl_s"),
        F.lit(None).cast("string").alias("source_hash"),
    )
