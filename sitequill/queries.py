"""Every query over the sample tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequill.functions import html, markup, net, text
from sitequill.operators import (
    agents,
    changes,
    content,
    detail,
    index,
    limits,
    routing,
    settings,
    terms,
    toplist,
)
from sitequill.plans import rebuild
from sitequill.plans.tables import Tables
from sitequill.session import cut_lineage, work_folder
from sitequill.sources import sample
from sitequill.sources.artifacts import append_artifacts, merge_artifacts, read_artifacts
from sitequill.streaming import jobs
from sitequill.streaming.limits import limit_stream, read_limits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
INDEX_TYPES = ["post", "page", "product"]
NOW_S = 1_704_067_200 + 45 * 60  # 45 minutes after the sample's start
LIMIT, WINDOW_S = 3, 86_400


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _settings(spark: SparkSession, sf: str) -> DataFrame:
    return settings.merge_settings(sample.site_settings(spark, sf))


# --- selecting content ------------------------------------------------------------------


@query
def published_topn(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.content(spark, sf).select(
        "site_id", "post_id", "post_type", "status", "published_at"
    )
    return content.newest_published(rows, _settings(spark, sf), limit=5).select(
        "site_id", "post_id", "post_type", "site_rank"
    )


@query
def published_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.content(spark, sf).select(
        "site_id", "post_id", "post_type", "status", "published_at"
    )
    return content.newest_published(rows, _settings(spark, sf), limit=-1).select(
        "site_id", "post_id", "post_type", "site_rank"
    )


@query
def lookup_by_slug(spark: SparkSession, sf: str) -> DataFrame:
    found = content.by_slug(
        sample.lookups(spark, sf).drop("post_id"),
        sample.content(spark, sf),
        _settings(spark, sf),
    )
    return found.select("lookup_id", "slug", "post_id", "permalink")


@query
def lookup_by_id(spark: SparkSession, sf: str) -> DataFrame:
    found = content.by_id(
        sample.lookups(spark, sf).select("lookup_id", "site_id", "post_id"),
        sample.content(spark, sf),
        ["post", "page"],
    )
    return found.select("lookup_id", "post_id", "post_type", "slug", "title")


@query
def counts_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return content.counts_by_type(sample.content(spark, sf), _settings(spark, sf))


@query
def total_count(spark: SparkSession, sf: str) -> DataFrame:
    return content.total_count(sample.content(spark, sf), ["post", "page", "secret"])


# --- text -------------------------------------------------------------------------------


@query
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return sample.spread_table(spark, sf, "pages").select(
        "page_id", text.clean_text(F.col("html")).alias("cleaned")
    )


@query
def excerpt(spark: SparkSession, sf: str) -> DataFrame:
    summary = F.when(F.col("doc_id") % 5 == 0, "0").otherwise("")
    return sample.spread_table(spark, sf, "documents").select(
        "doc_id",
        text.excerpt(summary, F.col("text")).alias("excerpt"),
        text.clean_text(F.col("text"), 50).alias("teaser"),
    )


@query
def page_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample.content(spark, sf)
    return rows.select(
        "site_id",
        "post_id",
        text.item_key(F.col("post_type"), F.col("slug")).alias("slug_key"),
        text.item_key(F.col("post_type"), F.col("post_id")).alias("id_key"),
        text.listing_key(F.array("post_type", F.lit("page"))).alias("listing_key"),
        text.client_key(F.col("site_id")).alias("client_key"),
        text.date_display(F.col("published_at")).alias("shown_date"),
    )


@query
def slug_keys(spark: SparkSession, sf: str) -> DataFrame:
    return sample.content(spark, sf, heavy=True).select(
        "post_id",
        text.slug_normalise(F.col("title")).alias("title_slug"),
        text.key_normalise(F.col("title")).alias("title_key"),
        text.raise_first(F.col("slug")).alias("raised"),
        text.header_text(F.col("content")).alias("plain"),
        text.email_text(F.col("title")).alias("email_chars"),
    )


@query
def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    return (
        sample.table(spark, sf, "documents")
        .select("doc_id", F.posexplode(text.line_list(F.col("text"))).alias("line_no", "line"))
        .select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")
    )


# --- site index -------------------------------------------------------------------------


@query
def term_strings(spark: SparkSession, sf: str) -> DataFrame:
    return terms.term_strings(sample.terms(spark, sf))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return index.index_entries(
        sample.content(spark, sf, heavy=True),
        sample.terms(spark, sf),
        sample.authors(spark, sf),
        sample.type_labels(spark),
        INDEX_TYPES,
    )


@query
def index_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).select(
        "site_id", "post_id", "label", "section_order", "position", "entry"
    )


@query
def quick_links(spark: SparkSession, sf: str) -> DataFrame:
    return index.quick_links(sample.content(spark, sf), sample.sites(spark, sf))


@query
def site_index(spark: SparkSession, sf: str) -> DataFrame:
    return index.site_index(
        _entries(spark, sf),
        sample.content(spark, sf),
        sample.sites(spark, sf),
        _settings(spark, sf),
    )


@query
def index_listing(spark: SparkSession, sf: str) -> DataFrame:
    return index.listing_rows(
        sample.content(spark, sf, heavy=True),
        sample.terms(spark, sf),
        sample.authors(spark, sf),
        sample.type_labels(spark),
        _settings(spark, sf),
    )


# --- HTML to Markdown -------------------------------------------------------------------


@query
def md_inline(spark: SparkSession, sf: str) -> DataFrame:
    return sample.spread_table(spark, sf, "pages").select(
        "page_id", html.inline_markup(html.drop_invisible(F.col("html"))).alias("marked")
    )


@query
def md_lists(spark: SparkSession, sf: str) -> DataFrame:
    return sample.list_pages(spark, sf).select(
        "doc_id", html.html_to_markdown(F.col("html")).alias("markdown")
    )


@query
def md_tables(spark: SparkSession, sf: str) -> DataFrame:
    return sample.order_tables(spark, sf).select(
        "order_id", html.html_to_markdown(F.col("html")).alias("markdown")
    )


@query
def md_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return sample.block_pages(spark, sf).select(
        "doc_id", html.html_to_markdown(F.col("html")).alias("markdown")
    )


@query
def html_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return sample.spread_table(spark, sf, "pages").select(
        "page_id", html.html_to_markdown(F.col("html")).alias("markdown")
    )


@query
def html_to_markdown_bounded(spark: SparkSession, sf: str) -> DataFrame:
    return sample.spread_table(spark, sf, "pages").select(
        "page_id", html.html_to_markdown(F.col("html"), strict=False).alias("markdown")
    )


@query
def page_documents(spark: SparkSession, sf: str) -> DataFrame:
    narrow = content.published(sample.content(spark, sf)).select("site_id", "post_id", "post_type")
    return _page_documents(spark, sf, content.of_types(narrow, _settings(spark, sf)))


def _page_documents(spark: SparkSession, sf: str, wanted: DataFrame) -> DataFrame:
    return detail.page_documents(
        content.published(sample.content(spark, sf, heavy=True)),
        sample.terms(spark, sf),
        sample.authors(spark, sf),
        sample.media(spark, sf),
        sample.sites(spark, sf),
        wanted=wanted.select("site_id", "post_id"),
    )


@query
def served_documents(spark: SparkSession, sf: str) -> DataFrame:
    return rebuild.served_documents(page_documents(spark, sf), site_index(spark, sf))


@query
def served_pages(spark: SparkSession, sf: str) -> DataFrame:
    newest = content.newest_by_slug(sample.content(spark, sf))
    pages = _page_documents(spark, sf, content.of_types(newest, _settings(spark, sf)))
    return rebuild.served_pages(pages, _overrides(spark, sf))


@query
def safe_markup(spark: SparkSession, sf: str) -> DataFrame:
    return sample.spread_table(spark, sf, "pages").select(
        "page_id", markup.safe_markup(F.col("html")).alias("safe")
    )


# --- agents -----------------------------------------------------------------------------


LINK_FORMS = [
    "https:", "javascript:", "&#106;avascript:", "java&#10;script:", "javascript&colon;",
    "JAVA\tSCRIPT:", "mailto:", "/path", "data:", "&amp;#106;avascript:", "h&#116;tps:",
]


@query
def safe_links(spark: SparkSession, sf: str) -> DataFrame:
    """The allow-list on links with plain, coded and split schemes around words of each text."""
    form = F.get(F.array(*[F.lit(f) for f in LINK_FORMS]), (F.col("doc_id") % len(LINK_FORMS)).cast("int"))
    word = F.regexp_extract("text", "[a-zA-Z]+", 0)
    link = F.concat(
        F.lit('<a href="'), form, F.lit("//x/"), F.col("doc_id").cast("string"),
        F.lit('" onclick="x()" title="t">'), word, F.lit("</a>"),
    )
    rows = sample.table(spark, sf, "documents")
    return rows.select("doc_id", markup.safe_markup(link).alias("link"))


@query
def agent_flags(spark: SparkSession, sf: str) -> DataFrame:
    return agents.with_agent(sample.requests(spark, sf)).select("request_id", "is_agent")


@query
def agent_names(spark: SparkSession, sf: str) -> DataFrame:
    return agents.with_agent(sample.requests(spark, sf)).select("request_id", "agent")


@query
def custom_agents(spark: SparkSession, sf: str) -> DataFrame:
    rows = routing.with_site_settings(sample.requests(spark, sf), _settings(spark, sf))
    return agents.with_agent(rows, F.col("custom_agents")).select(
        "request_id", "agent", "is_agent"
    )


@query
def custom_agents_indexed(spark: SparkSession, sf: str) -> DataFrame:
    rows, lists = sample.requests(spark, sf), _settings(spark, sf).select("site_id", "custom_agents")
    return agents.with_indexed_agent(rows, lists).select("request_id", "agent", "is_agent")


@query
def known_agents(spark: SparkSession, sf: str) -> DataFrame:
    """The token table beside the number of requests that each token names."""
    rows = agents.with_agent(sample.requests(spark, sf))
    counted = rows.groupBy(F.lower("agent").alias("lower_token")).agg(F.count("*").alias("requests"))
    table = agents.known_agents(spark).withColumn("lower_token", F.lower("token"))
    return table.join(counted, "lower_token", "left").select("rank", "vendor", "token", F.coalesce("requests", F.lit(0)).alias("requests"))


@query
def listable_types(spark: SparkSession, sf: str) -> DataFrame:
    """Listable types with their posts; attachments and types that are not public have no row."""
    posts = sample.content(spark, sf).withColumn("post_type", F.when(F.col("post_id") % 9 == 0, "attachment").otherwise(F.col("post_type")))
    types = content.listable_types(sample.type_labels(spark))
    return posts.join(types, "post_type").groupBy("post_type", "label").agg(F.count("*").alias("items"))


@query
def agent_activity(spark: SparkSession, sf: str) -> DataFrame:
    rows = agents.agent_activity(agents.with_agent(sample.requests(spark, sf)))
    return rows.select(
        F.unix_seconds("window_start").alias("window_start_s"), "agent", "requests"
    )


@query
def site_agent_activity(spark: SparkSession, sf: str) -> DataFrame:
    rows = agents.agent_activity(agents.with_agent(sample.requests(spark, sf)), keys=["site_id"])
    return rows.select(
        "site_id", F.unix_seconds("window_start").alias("window_start_s"), "agent", "requests"
    )


# --- addresses and settings -------------------------------------------------------------


@query
def client_ip(spark: SparkSession, sf: str) -> DataFrame:
    rows = routing.with_site_settings(sample.requests(spark, sf), _settings(spark, sf))
    return routing.with_client(rows).select("request_id", "client_ip", "client_key")


@query
def trusted_peers(spark: SparkSession, sf: str) -> DataFrame:
    rows = routing.with_site_settings(sample.requests(spark, sf), _settings(spark, sf))
    return rows.select(
        "request_id", net.is_trusted(F.col("peer"), F.col("trusted_proxies")).alias("trusted")
    )


@query
def peers_in_ranges(spark: SparkSession, sf: str) -> DataFrame:
    peers = sample.requests(spark, sf).select("site_id", net.ip_bits(F.col("peer")).alias("bits"))
    ranges = (
        _settings(spark, sf)
        .select("site_id", F.explode("trusted_proxies").alias("p"))
        .select("site_id", "p.prefix")
        .filter(F.col("prefix").isNotNull())
    )
    return routing.peers_in_ranges(peers, ranges, ["site_id"])


@query
def valid_ranges(spark: SparkSession, sf: str) -> DataFrame:
    event, user = F.col("event_id"), F.col("user_id")
    entry = (
        F.when(event % 9 == 0, F.concat(F.lit("10."), user % 300, F.lit(".0.0/"), event % 40))
        .when(event % 9 == 1, F.concat(F.lit("2001:db8:"), user, F.lit("::/"), event % 140))
        .when(event % 9 == 2, F.concat(F.lit("::ffff:192.0.2."), user % 300))
        .when(event % 9 == 3, F.concat(F.lit("192.0.2.0"), user))
        .when(event % 9 == 4, F.concat(F.lit("1:2:3:4:5:6:7:"), user))
        .when(event % 9 == 5, F.concat(F.lit("fe80::1::"), user))
        .when(event % 9 == 6, F.concat(F.lit("198.51.100."), user, F.lit("/x")))
        .when(event % 9 == 7, F.concat(F.lit("::"), user))
        .otherwise(F.concat(F.lit("host"), user))
    )
    rows = sample.spread_table(spark, sf, "events").select("event_id", entry.alias("entry"))
    return rows.select(
        "event_id",
        "entry",
        F.coalesce(net.is_ip_or_range(F.col("entry")), F.lit(False)).alias("valid"),
        net.ip_bits(F.col("entry")).alias("bits"),
        net.range_prefix(F.col("entry")).alias("prefix"),
    )


@query
def settings_merged(spark: SparkSession, sf: str) -> DataFrame:
    rows = _settings(spark, sf)
    return rows.select(
        "site_id",
        *settings.FLAGS,
        *settings.BOUNDS,
        F.array_join("post_types", ",").alias("post_types"),
        F.array_join(F.transform("trusted_proxies", lambda p: p["entry"]), ",").alias(
            "trusted_proxies"
        ),
        "site_description",
        "contact_email",
        F.array_join("custom_agents", ",").alias("custom_agents"),
    )


# --- limits -----------------------------------------------------------------------------


def _by_user(spark: SparkSession, sf: str) -> DataFrame:
    return sample.table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        sample.utc("ts").alias("ts"),
        F.col("user_id").cast("string").alias("client"),
    )


def _limited(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    return limits.with_limits(_by_user(spark, sf), ["client"], LIMIT, WINDOW_S, mode)


@query
def limit_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _limited(spark, sf, limits.ANCHORED).select(
        "request_id", "client", "request_count", "limited", "remaining"
    )


@query
def limit_refresh(spark: SparkSession, sf: str) -> DataFrame:
    return _limited(spark, sf, limits.REFRESHED).select(
        "request_id", "client", "request_count", "limited", "remaining"
    )


@query
def limit_headers(spark: SparkSession, sf: str) -> DataFrame:
    on = F.col("client").cast("bigint") % 7 != 0
    return limits.limit_headers(_limited(spark, sf, limits.ANCHORED), on).select(
        "request_id", "header_limit", "header_remaining", "header_reset"
    )


@query
def limit_events(spark: SparkSession, sf: str) -> DataFrame:
    return limits.limit_events(_limited(spark, sf, limits.REFRESHED), ["client"]).select(
        "request_id", "client", "request_count", "max_requests"
    )


# --- routing ----------------------------------------------------------------------------


@query
def route_paths(spark: SparkSession, sf: str) -> DataFrame:
    return routing.with_route(sample.requests(spark, sf)).select(
        "request_id", "endpoint", "route_type", "route_slug", "route_page"
    )


@query
def redirects(spark: SparkSession, sf: str) -> DataFrame:
    rows = routing.with_site_settings(
        routing.with_route(sample.requests(spark, sf)), _settings(spark, sf)
    )
    return routing.redirects(
        rows, sample.content(spark, sf), sample.sites(spark, sf), _settings(spark, sf)
    ).select("request_id", "agent", "target", "status")


def _overrides(spark: SparkSession, sf: str) -> DataFrame:
    return sample.sites(spark, sf).select(
        "site_id",
        F.lit("p1").alias("route_page"),
        F.when(F.length("site_id") % 2 == 0, "# Fixed text").otherwise("").alias("content"),
    )


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return routing.outcomes(
        sample.requests(spark, sf),
        sample.content(spark, sf),
        _settings(spark, sf),
        _overrides(spark, sf),
    )


@query
def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf).select(
        "request_id", "client_ip", "endpoint", "request_count", "limited", "found_id",
        "reason", "status",
    )


@query
def unknown_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Front addresses that name their endpoint; a name that is none of them is not found."""
    request = F.col("request_id")
    named = (
        F.when(request % 8 == 4, F.get(F.array(*[F.lit(x) for x in ("index", "feed", "")]), (request % 3).cast("int")))
        .when(request % 8 == 7, F.concat(F.lit("item&type=post&slug=p"), request % 50))
    )
    rows = sample.requests(spark, sf).withColumn("path", F.coalesce(F.concat(F.lit("/?endpoint="), named), F.col("path")))
    judged = routing.outcomes(rows, sample.content(spark, sf), _settings(spark, sf))
    return judged.filter(F.col("path").startswith("/?")).select("request_id", "endpoint", "route_type", "route_slug", "reason", "status")


@query
def hooked_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes where a hook hides every third post from single lookups."""
    judged = routing.outcomes(
        sample.requests(spark, sf), sample.content(spark, sf), _settings(spark, sf),
        item_hook=lambda rows: rows.filter(F.col("post_id") % 3 != 0),
    )
    return judged.select("request_id", "found_id", "reason", "status")


@query
def response_headers(spark: SparkSession, sf: str) -> DataFrame:
    return routing.response_headers(_outcomes(spark, sf)).select(
        "request_id", "content_type", "cache_control", "robots_tag", "retry_after",
        "header_limit", "header_remaining", "header_reset",
    )


@query
def error_documents(spark: SparkSession, sf: str) -> DataFrame:
    return routing.error_documents(_outcomes(spark, sf)).select(
        "request_id", "status", "reason", "content"
    )


# --- incremental rebuild ----------------------------------------------------------------


def _stale(spark: SparkSession, sf: str) -> DataFrame:
    return changes.stale_keys(
        sample.content_changes(spark, sf), sample.content(spark, sf), _settings(spark, sf)
    )


def _expired(spark: SparkSession, sf: str) -> DataFrame:
    return changes.expired(sample.artifacts(spark, sf), F.timestamp_seconds(F.lit(NOW_S)))


@query
def stale_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _stale(spark, sf)


def _snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    return changes.snapshot_changes(*sample.snapshots(spark, sf), F.timestamp_seconds(F.lit(NOW_S)))


@query
def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _snapshot_changes(spark, sf).select(
        "site_id", "post_id", "event", "post_type", "slug", "old_status", "new_status"
    )


@query
def snapshot_stale_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The diff of two snapshots as a change feed: moved posts leave the key of their old address stale."""
    return changes.stale_keys(_snapshot_changes(spark, sf), sample.snapshots(spark, sf)[1], _settings(spark, sf))


@query
def index_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The index of the later snapshot, from a list stored for the earlier one and the feed between them."""
    limit, margin = 3, 1
    before, after = sample.snapshots(spark, sf)
    types = _settings(spark, sf)
    stored = cut_lineage(toplist.first_rows(before, types, limit, margin), "top-list")
    now = toplist.followed(stored, _snapshot_changes(spark, sf), after, types, limit, margin)
    rows = index.entries_of(
        now.filter(F.col("site_rank") <= limit).drop("more"),
        sample.terms(spark, sf),
        sample.authors(spark, sf),
        sample.type_labels(spark),
        limit,
    )
    return rows.select("site_id", "post_id", "label", "section_order", "position", "entry")


@query
def expired(spark: SparkSession, sf: str) -> DataFrame:
    return _expired(spark, sf).select("site_id", "kind", "artifact_key", "ttl_s")


@query
def rebuild_set(spark: SparkSession, sf: str) -> DataFrame:
    keys = changes.keys_to_rebuild(_stale(spark, sf), _expired(spark, sf))
    return changes.items_to_rebuild(
        sample.content(spark, sf), _settings(spark, sf), keys
    ).select("site_id", "post_id", "post_type", "slug")


@query
def cleared_counts(spark: SparkSession, sf: str) -> DataFrame:
    return changes.cleared_counts(
        changes.of_kind(sample.artifacts(spark, sf), text.ITEM_PREFIX)
    )


@query
def rebuilt_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    rows = rebuild.rebuilt(
        Tables.sample(spark, sf),
        sample.content_changes(spark, sf),
        sample.artifacts(spark, sf),
        F.timestamp_seconds(F.lit(NOW_S)),
    )
    return rows.select(
        "site_id", "artifact_key", "kind", "ttl_s", F.col("source_hash").alias("content_md5")
    )


@query
def live_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Render everything, then take every fifth page offline, then clear the listings."""
    folder, now = work_folder(spark, "live"), F.timestamp_seconds(F.lit(NOW_S))
    tables = Tables.sample(spark, sf)
    rebuild.render_all(tables, folder, now, 0)
    gone = F.col("post_id") % 5 == 0
    later = tables.content.withColumn("status", F.when(gone, "trash").otherwise(F.col("status")))
    trashed = tables.content.filter(gone).select(
        "site_id", "post_id", now.alias("ts"), F.lit("trash").alias("event"),
        F.col("status").alias("old_status"), F.lit("trash").alias("new_status"),
        F.lit(False).alias("is_autosave"), F.lit(False).alias("is_revision"),
    )
    rebuild.rebuild_stored(replace(tables, content=later), trashed, folder, now, 1)
    merge_artifacts(spark, folder, now)
    stored = read_artifacts(spark, folder)
    rebuild.clear_kind(stored, text.LISTING_PREFIX, folder, now, "2")
    return read_artifacts(spark, folder).select(
        "site_id", "artifact_key", "kind", "ttl_s", F.col("source_hash").alias("content_md5")
    )


@query
def rebuild_events(spark: SparkSession, sf: str) -> DataFrame:
    """What a rebuild of the stored artefacts and a clearing of the listings leave as events."""
    folder, now = work_folder(spark, "events"), F.timestamp_seconds(F.lit(NOW_S))
    append_artifacts(sample.artifacts(spark, sf), f"{folder}/store", 0)
    log = sample.content_changes(spark, sf)
    rebuild.rebuild_stored(Tables.sample(spark, sf), log, f"{folder}/store", now, 1, f"{folder}/events")
    stored = read_artifacts(spark, f"{folder}/store")
    rebuild.clear_kind(stored, text.LISTING_PREFIX, f"{folder}/store", now, "2", f"{folder}/events")
    return rebuild.read_events(spark, f"{folder}/events").select("site_id", "kind", "event", "n")


# --- streams ----------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = sample.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")


def _stream_limited(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    folder = work_folder(spark, f"stream-{mode}")
    rows = _user_requests(_event_stream(spark, sf))
    limit_stream(rows, ["client"], f"{folder}/out", f"{folder}/state", mode).awaitTermination()
    return read_limits(spark, f"{folder}/out").select(
        "request_id", "client", "request_count", "limited"
    )


def _user_requests(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("request_id"),
        sample.utc("ts").alias("ts"),
        F.col("user_id").cast("string").alias("client"),
        F.lit(LIMIT).cast("bigint").alias("max_requests"),
        F.lit(WINDOW_S).cast("bigint").alias("window_s"),
    )


@query
def stream_limit_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _stream_limited(spark, sf, limits.ANCHORED)


@query
def stream_limit_refresh(spark: SparkSession, sf: str) -> DataFrame:
    return _stream_limited(spark, sf, limits.REFRESHED)


@query
def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Odd events first, even ones in a second run: what is older than its client's last second."""
    folder = work_folder(spark, "stream-late")
    events = _user_requests(sample.table(spark, sf, "events"))
    for part in (1, 0):
        events.filter(F.col("request_id") % 2 == part).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        limit_stream(source, ["client"], f"{folder}/out", f"{folder}/state").awaitTermination()
    late = read_limits(spark, f"{folder}/out", "late").select("request_id", "client", F.lit(True).alias("late"))
    judged = read_limits(spark, f"{folder}/out").select("request_id", "client", F.lit(False).alias("late"))
    return late.unionByName(judged)


@query
def stream_agent_activity(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_folder(spark, "stream-activity")
    rows = sample.requests_from(_event_stream(spark, sf), spark, sf)
    jobs.activity_stream(
        agents.with_agent(rows), f"{folder}/out", f"{folder}/state", "1 day"
    ).awaitTermination()
    return jobs.read_activity(spark, f"{folder}/out").select(
        F.unix_seconds("window_start").alias("window_start_s"), "agent", "requests"
    )


@query
def stream_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    folder = work_folder(spark, "stream-rebuild")
    jobs.rebuild_stream(
        sample.changes_from(_event_stream(spark, sf), spark, sf),
        lambda: Tables.sample(spark, sf),
        f"{folder}/out",
        f"{folder}/state",
        F.timestamp_seconds(F.lit(NOW_S)),
    ).awaitTermination()
    return read_artifacts(spark, f"{folder}/out").select(
        "site_id", "artifact_key", "kind", "ttl_s", F.col("source_hash").alias("content_md5")
    )


@query
def stream_agent_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Odd events first, even ones in a second run: what is older than the open windows is counted as late."""
    folder, width, delay = work_folder(spark, "stream-windows"), "1 day", "5 days"
    events = sample.table(spark, sf, "events")
    for part in (1, 0):
        events.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        rows = agents.with_agent(sample.requests_from(source, spark, sf)).select("site_id", "ts", "agent")
        jobs.split_late(rows, folder, f"{folder}/split-state", width, delay).awaitTermination()
        jobs.window_stream(spark, folder, f"{folder}/window-state", width, delay).awaitTermination()
    return jobs.read_windows(spark, folder, width).select(
        "site_id", F.unix_seconds("window_start").alias("window_start_s"), "agent", "requests", "late_requests"
    )
