"""Explicit schemas: the host fixes them, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_long, _int, _text, _flag = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
_local, _instant, _texts = T.TimestampNTZType(), T.TimestampType(), T.ArrayType(T.StringType())

CONTENT = _struct(
    site_id=_text,
    post_id=_long,
    post_type=_text,
    status=_text,
    slug=_text,
    title=_text,
    excerpt=_text,
    content=_text,
    author_id=_long,
    published_at=_local,
    modified_at=_local,
    permalink=_text,
)
TERMS = _struct(site_id=_text, post_id=_long, taxonomy=_text, term_order=_int, name=_text)
AUTHORS = _struct(author_id=_long, display_name=_text, archive_url=_text)
MEDIA = _struct(site_id=_text, post_id=_long, image_url=_text, image_alt=_text)
SITES = _struct(
    site_id=_text,
    site_name=_text,
    description=_text,
    home_url=_text,
    admin_email=_text,
    front_page_id=_long,
)
TYPE_LABELS = _struct(post_type=_text, label=_text, is_public=_flag)
SITE_SETTINGS = _struct(
    site_id=_text,
    enabled=_text,
    index_enabled=_text,
    item_endpoints_enabled=_text,
    redirect_enabled=_text,
    post_types=_texts,
    index_ttl_s=_long,
    item_ttl_s=_long,
    limit_enabled=_text,
    limit_requests=_long,
    limit_window_s=_long,
    trusted_proxies=_text,
    site_description=_text,
    contact_email=_text,
    noindex=_text,
    custom_agents=_text,
)
REQUESTS = _struct(
    request_id=_long,
    ts=_instant,
    site_id=_text,
    path=_text,
    user_agent=_text,
    accept=_text,
    peer=_text,
    cf_connecting_ip=_text,
    x_forwarded_for=_text,
    x_real_ip=_text,
    client_ip_header=_text,
)
CONTENT_CHANGES = _struct(
    change_id=_long,
    ts=_instant,
    site_id=_text,
    post_id=_long,
    event=_text,
    old_status=_text,
    new_status=_text,
    is_autosave=_flag,
    is_revision=_flag,
)
ARTIFACTS = _struct(
    site_id=_text,
    artifact_key=_text,
    kind=_text,
    content=_text,
    generated_at=_instant,
    ttl_s=_long,
    source_hash=_text,
)

TABLES = {
    "content": CONTENT,
    "terms": TERMS,
    "authors": AUTHORS,
    "media": MEDIA,
    "sites": SITES,
    "type_labels": TYPE_LABELS,
    "site_settings": SITE_SETTINGS,
    "requests": REQUESTS,
    "content_changes": CONTENT_CHANGES,
    "artifacts": ARTIFACTS,
}
