"""Per-site settings: clean-up, bounds and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequill.functions import net, text
from sitequill.functions.basics import nonempty

# Defaults and bounds.
DEFAULTS = {
    "enabled": True,
    "index_enabled": True,
    "item_endpoints_enabled": True,
    "redirect_enabled": True,
    "post_types": ["post", "page"],
    "index_ttl_s": 3600,
    "item_ttl_s": 600,
    "limit_enabled": True,
    "limit_requests": 60,
    "limit_window_s": 60,
    "trusted_proxies": "",
    "site_description": "",
    "contact_email": "",
    "noindex": True,
    "custom_agents": "",
}
BOUNDS = {
    "index_ttl_s": (60, 86400),
    "item_ttl_s": (60, 86400),
    "limit_requests": (10, 1000),
    "limit_window_s": (10, 3600),
}
FLAGS = [
    "enabled",
    "index_enabled",
    "item_endpoints_enabled",
    "redirect_enabled",
    "limit_enabled",
    "noindex",
]


def _flag(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.lit(DEFAULTS[name])).otherwise(nonempty(F.col(name)))


def _number(name: str) -> Column:
    low, high = BOUNDS[name]
    value = F.coalesce(F.col(name), F.lit(DEFAULTS[name]).cast("bigint"))
    return text.bounded_int(value, low, high).cast("bigint")


def _types() -> Column:
    default = F.array(*[F.lit(t) for t in DEFAULTS["post_types"]])
    cleaned = F.transform("post_types", text.key_normalise)
    return F.when(F.size(cleaned) > 0, cleaned).otherwise(default)


def merge_settings(raw: DataFrame) -> DataFrame:
    """Stored settings with clean-up and defaults applied, one narrow row per site.

    ``trusted_proxies`` becomes an array of (entry, prefix): the valid addresses and ranges
    of the list. ``custom_agents`` becomes the array of tokens in listed order.
    """
    return raw.select(
        "site_id",
        *[_flag(name).alias(name) for name in FLAGS],
        *[_number(name).alias(name) for name in BOUNDS],
        _types().alias("post_types"),
        net.valid_entries(text.line_list(F.col("trusted_proxies"))).alias("trusted_proxies"),
        text.header_text(F.col("site_description")).alias("site_description"),
        text.email_text(F.col("contact_email")).alias("contact_email"),
        text.line_list(text.header_text(F.col("custom_agents"))).alias("custom_agents"),
    )
