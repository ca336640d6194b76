"""Where a request goes: route, redirect for agents, outcome, response text and headers."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequill.functions.basics import nonempty
from sitequill.functions.net import client_ip
from sitequill.functions.text import client_key, key_normalise, slug_normalise
from sitequill.operators.agents import agent_name
from sitequill.operators.content import newest_by_slug, of_types
from sitequill.operators.limits import ANCHORED, with_limits
from sitequill.operators.scale import lookup_join
from sitequill.session import cut_lineage

# Executors get these few functions with the query and need no installed package.
register_pickle_by_value(sys.modules[__name__])

#: Length of a prefix that names a family of addresses and no bit.
FAMILY_MARK = 2

# Routes, states and messages.
INDEX_ROUTE = r"^/llms\.txt$"
ITEM_ROUTE = "^/ai/content/([^/]+)/([^/]+)/?$"
PAGE_ROUTE = "^/ai/content/([^/]+)/?$"
ENDPOINTS = ["index", "item", "page"]
OTHER = "other"
INDEX_PATH = "/llms.txt"
ITEM_PATH = "/ai/content/"
REDIRECT_STATUS = 307
FORWARDING_HEADERS = [
    "cf_connecting_ip",
    "x_forwarded_for",
    "x_real_ip",
    "client_ip_header",
]
ERRORS = {
    "disabled": (404, "Service Unavailable", "{service} is currently disabled.", None),
    "limited": (429, "Too Many Requests", None, None),
    "index off": (
        404,
        "Not Found",
        "The llms.txt endpoint is currently disabled.",
        "Contact the site administrator if you believe this is an error.",
    ),
    "items off": (404, "Not Found", "AI content endpoints are currently disabled.", None),
    "missing part": (
        400,
        "Bad Request",
        "Missing post_type or slug parameter.",
        "URL format: /ai/content/{post_type}/{slug}",
    ),
    "no item": (
        404,
        "Not Found",
        "The requested content was not found.",
        "Check /llms.txt for available content.",
    ),
    "no page": (
        404,
        "Not Found",
        'Page "{page}" not found.',
        "Check /llms.txt for available pages.",
    ),
    "unknown": (404, "Not Found", "Unknown endpoint.", None),
}
MARKDOWN_CONTENT_TYPE = "text/markdown; charset=utf-8"
SERVICE_NAME = "Site index"


def _parameter(path: Column, name: str) -> Column:
    """The value of a parameter in the query part of an address; null when it isn't there."""
    pattern = rf"^/(?:index\.php)?[?](?:[^#]*&)?{name}=([^&#]*)"
    return F.when(path.rlike(pattern), F.regexp_extract(path, pattern, 1))


def with_route(requests: DataFrame) -> DataFrame:
    """Add endpoint (index, item, page, other or null), route_type, route_slug and route_page.

    A front address may name the endpoint in its parameter ``endpoint``, with the parts in
    ``type``, ``slug`` and ``page``; a name that is none of the endpoints is ``other``.
    """
    path = F.col("path")
    part = lambda pattern, n: F.regexp_extract(path, pattern, n)
    named = F.nullif(_parameter(path, "endpoint"), F.lit(""))
    endpoint = (
        F.when(path.rlike(INDEX_ROUTE), "index")
        .when(path.rlike(ITEM_ROUTE), "item")
        .when(path.rlike(PAGE_ROUTE), "page")
        .when(named.isin(ENDPOINTS), named)
        .when(named.isNotNull(), OTHER)
    )
    routed = requests.withColumn("endpoint", endpoint)
    is_item, is_page = F.col("endpoint") == "item", F.col("endpoint") == "page"

    def of(pattern: str, n: int, name: str) -> Column:
        return F.coalesce(F.when(path.rlike(pattern), part(pattern, n)), _parameter(path, name), F.lit(""))

    return (
        routed.withColumn("route_type", F.when(is_item, key_normalise(of(ITEM_ROUTE, 1, "type"))))
        .withColumn("route_slug", F.when(is_item, slug_normalise(of(ITEM_ROUTE, 2, "slug"))))
        .withColumn("route_page", F.when(is_page, key_normalise(of(PAGE_ROUTE, 1, "page"))))
    )


def with_site_settings(requests: DataFrame, settings: DataFrame) -> DataFrame:
    return lookup_join(requests, settings, ["site_id"])


def with_client(requests: DataFrame) -> DataFrame:
    """Add client_ip and client_key; needs ``trusted_proxies`` from the settings."""
    address = client_ip(
        F.col("peer"), F.col("trusted_proxies"), [F.col(h) for h in FORWARDING_HEADERS]
    )
    return requests.withColumn("client_ip", address).withColumn(
        "client_key", client_key(F.col("client_ip"))
    )


def _targets(content: DataFrame, settings: DataFrame) -> DataFrame:
    return of_types(newest_by_slug(content), settings).select(
        "site_id",
        F.col("post_type").alias("wanted_type"),
        F.col("slug").alias("wanted_slug"),
        F.col("post_id").alias("found_id"),
    )


def with_item(
    requests: DataFrame,
    content: DataFrame,
    settings: DataFrame,
    item_hook: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add found_id: the published, allowed item or page that the request asks for.

    ``item_hook`` changes the content rows before items are looked up.
    """

    def wanted(rows: DataFrame) -> DataFrame:
        page = F.when(F.col("endpoint") == "page", "page")
        return rows.withColumn("wanted_type", F.coalesce("route_type", page)).withColumn(
            "wanted_slug", F.coalesce("route_slug", slug_normalise(F.col("route_page")))
        )

    return lookup_join(
        wanted(requests),
        _targets(item_hook(content) if item_hook else content, settings),
        ["site_id", "wanted_type", "wanted_slug"],
    ).drop("wanted_type", "wanted_slug")


def redirects(
    requests: DataFrame,
    content: DataFrame,
    sites: DataFrame,
    settings: DataFrame,
    checked_front_page: bool = False,
) -> DataFrame:
    """Agents on ordinary pages and where they are sent.

    ``requests`` carries route and settings columns. Every eligible agent request is a row,
    an "agent seen" event; ``target`` is null where no redirect follows. The front page is
    used as it is unless ``checked_front_page`` asks for a published one.
    """
    agents = requests.withColumn(
        "agent", agent_name(F.col("user_agent"), F.col("accept"), F.col("custom_agents"))
    ).filter(
        F.col("endpoint").isNull()
        & F.col("agent").isNotNull()
        & F.col("enabled")
        & F.col("redirect_enabled")
        & F.col("item_endpoints_enabled")
    )
    viewed = content.select(
        "site_id",
        F.regexp_extract("permalink", "^https?://[^/]+(/.*)$", 1).alias("path"),
        "post_id",
        F.struct("post_type", "slug", "status").alias("item"),
    )
    # One post per address: an address shared by several posts shows the newest published one.
    viewed = (
        viewed.filter(F.col("item.status") == "publish")
        .groupBy("site_id", "path")
        .agg(F.max(F.struct("post_id", "item")).alias("v"))
        .select("site_id", "path", F.col("v.item").alias("item"))
    )
    fronts = content.select(
        "site_id", F.col("post_id").alias("front_page_id"), "slug", "status"
    )
    if checked_front_page:
        fronts = fronts.filter(F.col("status") == "publish")
    homes = sites.join(fronts, ["site_id", "front_page_id"], "left").select(
        "site_id", "home_url", F.col("slug").alias("front_slug")
    )
    rows = lookup_join(agents, homes, ["site_id"])
    rows = lookup_join(rows, viewed, ["site_id", "path"])
    item_target = F.concat(
        "home_url", F.lit(ITEM_PATH), F.col("item.post_type"), F.lit("/"), F.col("item.slug")
    )
    home_target = F.when(
        F.col("front_slug").isNotNull(),
        F.concat("home_url", F.lit(f"{ITEM_PATH}page/"), "front_slug"),
    ).otherwise(F.concat("home_url", F.lit(INDEX_PATH)))
    target = F.when(
        F.col("item").isNotNull()
        & F.array_contains("post_types", F.col("item.post_type")),
        item_target,
    ).when(F.col("path") == "/", home_target)
    return rows.select(
        "request_id",
        "site_id",
        "ts",
        "agent",
        target.alias("target"),
        F.when(target.isNotNull(), F.lit(REDIRECT_STATUS)).alias("status"),
    )


def outcomes(
    requests: DataFrame,
    content: DataFrame,
    settings: DataFrame,
    overrides: DataFrame | None = None,
    mode: str = ANCHORED,
    item_hook: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The verdict on every endpoint request: status, reason, item found, limit columns.

    ``overrides`` (site_id, route_page, content) are fixed texts for page names; ``item_hook``
    changes the content rows before items are looked up.
    """
    routed = with_route(requests).filter(F.col("endpoint").isNotNull())
    judged = with_limits(
        with_client(with_site_settings(routed, settings)),
        ["site_id", "client_ip"],
        F.col("limit_requests"),
        F.col("limit_window_s"),
        mode,
        counted=F.col("enabled") & F.col("limit_enabled"),
    )
    found = with_item(judged, content, settings, item_hook)
    if overrides is not None:
        # A null text is no override; an empty one says that there is no page.
        fixed = overrides.filter(F.col("content").isNotNull()).select(
            "site_id", "route_page", nonempty(F.col("content")).alias("has_override")
        )
        found = lookup_join(found, fixed, ["site_id", "route_page"])
    else:
        found = found.withColumn("has_override", F.lit(None).cast("boolean"))
    item, page = F.col("endpoint") == "item", F.col("endpoint") == "page"
    page_shown = F.coalesce("has_override", F.col("found_id").isNotNull())
    reason = (
        F.when(~F.col("enabled"), "disabled")
        .when(F.col("limited"), "limited")
        .when((F.col("endpoint") == "index") & ~F.col("index_enabled"), "index off")
        .when(F.col("endpoint") == OTHER, "unknown")
        .when((item | page) & ~F.col("item_endpoints_enabled"), "items off")
        .when(
            item & ~(nonempty(F.col("route_type")) & nonempty(F.col("route_slug"))),
            "missing part",
        )
        .when(item & F.col("found_id").isNull(), "no item")
        .when(page & ~page_shown, "no page")
        .otherwise("ok")
    )
    status = F.lit(200)
    for name, (code, *_rest) in ERRORS.items():
        status = F.when(F.col("reason") == name, F.lit(code)).otherwise(status)
    return found.withColumn("reason", reason).withColumn("status", status)


def response_headers(outcome_rows: DataFrame) -> DataFrame:
    """Header columns for outcome rows; null means the header is not sent."""
    ok, limited = F.col("reason") == "ok", F.col("reason") == "limited"
    ttl = F.when(F.col("endpoint") == "index", F.col("index_ttl_s")).otherwise(
        F.col("item_ttl_s")
    )
    sent = ok | limited
    return outcome_rows.select(
        "*",
        F.lit(MARKDOWN_CONTENT_TYPE).alias("content_type"),
        F.when(ok, F.concat(F.lit("public, max-age="), ttl.cast("string")))
        .otherwise("no-cache")
        .alias("cache_control"),
        F.when(ok & F.col("noindex"), "noindex").alias("robots_tag"),
        F.when(limited, F.col("limit_window_s")).alias("retry_after"),
        F.when(sent, F.col("limit_requests")).alias("header_limit"),
        F.when(sent, F.coalesce("remaining", F.lit(0).cast("bigint"))).alias(
            "header_remaining"
        ),
        F.when(sent, F.unix_seconds("ts") + F.col("limit_window_s")).alias("header_reset"),
    )


def error_text(
    status: int, title: str, message: Column, suggestion: Column | None = None,
    documentation: Column | None = None, service: str = SERVICE_NAME,
) -> Column:
    """An error document; suggestion and documentation sections are optional."""

    def section(name: str, body: Column | None) -> Column:
        if body is None:
            return F.lit("")
        return F.coalesce(
            F.when(nonempty(body), F.concat(F.lit(f"\n## {name}\n\n"), body, F.lit("\n"))),
            F.lit(""),
        )

    return F.concat(
        F.lit(f"# {status} {title}\n\n"),
        message,
        F.lit("\n"),
        section("Suggestion", suggestion),
        section("Documentation", documentation),
        F.lit(f"\n---\n\n*{service}*\n"),
    )


def limit_text(limit: Column, window: Column, service: str = SERVICE_NAME) -> Column:
    return F.format_string(
        "# 429 Too Many Requests\n\n"
        "Rate limit exceeded. You have made too many requests.\n\n"
        "## Limits\n\n"
        "- **Maximum requests:** %d per %d seconds\n"
        "- **Retry after:** %d seconds\n\n"
        f"---\n\n*{service}*\n",
        limit,
        window,
        window,
    )


def _escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def error_documents(outcome_rows: DataFrame, service: str = SERVICE_NAME) -> DataFrame:
    """The Markdown body of every request that did not succeed."""
    body = F.lit(None).cast("string")
    for name, (code, title, message, suggestion) in ERRORS.items():
        if name == "limited":
            text = limit_text(F.col("limit_requests"), F.col("limit_window_s"), service)
        else:
            before, _, after = message.replace("{service}", service).partition("{page}")
            told = F.lit(before)
            if "{page}" in message:
                told = F.concat(told, _escape_html(F.col("route_page")), F.lit(after))
            text = error_text(
                code, title, told, F.lit(suggestion) if suggestion else None, service=service
            )
        body = F.when(F.col("reason") == name, text).otherwise(body)
    return outcome_rows.filter(F.col("reason") != "ok").select(
        "request_id", "site_id", "status", "reason", body.alias("content")
    )


def _covers(names: Sequence[str]):
    """Prefixes come sorted by key; a prefix comes before those inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, done = None, [], []
        schema = None

        def close():
            done.extend((*now, p) for p in open_)
            open_.clear()

        for batch in batches:
            schema = batch.schema
            for *key, prefix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    close()
                    now = key
                if open_ and prefix.startswith(open_[-1]):
                    continue
                # A prefix can still be merged only if what comes next lies inside its sibling.
                waiting = [p for p in open_ if p[-1] == "0" and prefix.startswith(p[:-1] + "1")]
                done.extend((*now, p) for p in open_ if p not in waiting)
                open_[:] = [*waiting, prefix]
                while len(open_) > 1 and open_[-1][-1] == "1" and open_[-2] == open_[-1][:-1] + "0":
                    open_[-2:] = [open_[-1][:-1]]
            yield _rows(done, schema)
            done.clear()
        if schema is not None:
            close()
            yield _rows(done, schema)

    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def prefix_cover(ranges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The smallest set of disjoint prefixes that covers the same addresses, per key.

    A prefix inside another goes, two halves of a range become the range. The sorted prefixes of
    a key stream through a task, which holds at most one for each bit of an address. Null
    prefixes and repeats go.
    """
    keys = list(keys)
    rows = ranges.select(*keys, "prefix").filter(F.col("prefix").isNotNull()).distinct()
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "prefix") if keys else rows.repartition(1).sortWithinPartitions("prefix")
    return ordered.mapInArrow(_covers([*keys, "prefix"]), ordered.schema)


def peers_in_ranges(peers: DataFrame, ranges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Semi join of addresses (column ``bits``) with many ranges (column ``prefix``).

    A range join as an equality join: the ranges of a key are reduced to disjoint prefixes, and
    each distinct address is cut to the lengths that its own key uses, at most 33 for IPv4 and
    129 for IPv6; at most one cut is found. A range of all addresses of a family is no join key:
    its key lets every address of the family pass.
    """
    keys, one = list(keys), F.lit(0).alias("_one")
    by = [*keys, "family"] if keys else ["_one", "family"]
    family = lambda c: F.substring(c, 1, 1).alias("family")
    cover = cut_lineage(prefix_cover(ranges, keys), "prefix-cover").select("*", family("prefix"), *([] if keys else [one]))
    sizes = cover.groupBy(*by).agg(F.collect_set(F.length("prefix")).alias("sizes"))
    seen = peers.select(*keys, "bits").filter(F.col("bits").isNotNull()).distinct().select("*", family("bits"), *([] if keys else [one]))
    asked = lookup_join(seen, sizes, by, "inner")
    whole = F.array_contains("sizes", F.lit(FAMILY_MARK))
    cuts = (
        asked.filter(~whole)
        .withColumn("size", F.explode("sizes"))
        .filter(F.col("size") <= F.length("bits"))
        .select(*by, "bits", F.substring(F.col("bits"), F.lit(1), F.col("size")).alias("prefix"))
    )
    # Covers are disjoint, so an address is found once.
    found = cuts.join(cover.select(*by, "prefix"), [*by, "prefix"], "left_semi")
    return asked.filter(whole).select(*keys, "bits").unionByName(found.select(*keys, "bits"))
