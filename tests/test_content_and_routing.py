from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitequill.operators import changes, content, detail, index, routing, terms
from sitequill.operators.settings import merge_settings
from sitequill.sources import schemas

SITE = "https://example.com"


def post(post_id, **kw):
    row = {
        "site_id": "s", "post_id": post_id, "post_type": "post", "status": "publish",
        "slug": f"test-post-{post_id}", "title": "Test Post", "excerpt": "Test excerpt",
        "content": "Test content", "author_id": 1,
        "published_at": datetime(2024, 1, 1, 12), "modified_at": datetime(2024, 1, 1, 12),
    } | kw
    row["permalink"] = f"{SITE}/{row['post_type']}/{row['slug']}/"
    return tuple(row[f] for f in schemas.CONTENT.fieldNames())


@pytest.fixture(scope="module")
def make(spark):
    def build(name, rows):
        return spark.createDataFrame(rows, getattr(schemas, name))

    return build


@pytest.fixture(scope="module")
def sides(make):
    return {
        "terms": make("TERMS", [
            ("s", 1, "category", 1, "News"), ("s", 1, "category", 2, "Technology"),
            ("s", 1, "post_tag", 3, "News"), ("s", 1, "post_format", 4, "aside"),
            ("s", 1, "_internal", 5, "x"),
        ]),
        "authors": make("AUTHORS", [(1, "Ann", f"{SITE}/author/1/")]),
        "media": make("MEDIA", [("s", 1, f"{SITE}/i.jpg", "Alt")]),
        "sites": make("SITES", [("s", "Site", "About it", SITE, "admin@x.org", None)]),
        "labels": make("TYPE_LABELS", [("post", "Posts", True), ("page", "Pages", True)]),
    }


def settings_of(make, **kw):
    names = schemas.SITE_SETTINGS.fieldNames()
    return merge_settings(
        make("SITE_SETTINGS", [tuple({"site_id": "s"}.get(n, kw.get(n)) for n in names)])
    )


def test_published_types_and_limit(make):
    rows = make("CONTENT", [
        post(1), post(2, post_type="page"), post(3, post_type="secret"), post(4, status="draft"),
        post(5, status="pending"), post(6, published_at=datetime(2024, 1, 2)), post(7),
    ])
    newest = content.newest_published(rows, ["post", "page"], limit=3).orderBy("site_rank")
    assert [r.post_id for r in newest.collect()] == [6, 7, 2]  # ties: the higher id first
    counts = content.counts_by_type(rows, ["post", "page", "product"]).collect()
    assert {r.post_type: r["items"] for r in counts} == {"post": 3, "page": 1, "product": 0}
    assert content.total_count(rows, ["post", "page"]).first()["items"] == 4


def test_point_reads(make, spark):
    rows = make("CONTENT", [post(1, slug="hello"), post(2, status="draft", slug="gone")])
    wanted = spark.createDataFrame(
        [(1, "s", "post", "Hello"), (2, "s", "post", "gone"), (3, "s", "secret", "hello")],
        "lookup_id long, site_id string, post_type string, slug string",
    )
    got = content.by_slug(wanted, rows, ["post"]).orderBy("lookup_id").collect()
    assert [r.post_id for r in got] == [1, None, None]


def test_terms(sides):
    assert [r.terms for r in terms.term_strings(sides["terms"]).collect()] == ["News, Technology"]


def test_index_document(make, sides):
    rows = make("CONTENT", [
        post(1, title="First &amp; best"),
        post(2, post_type="product", excerpt="", content="<p>Body</p>", author_id=9,
             published_at=datetime(2024, 1, 2)),
        post(3, post_type="page", slug="about", title="About Us", excerpt="0", content=""),
    ])
    site_settings = settings_of(make, post_types=["post", "product"], contact_email="me@x.org")
    entries = index.index_entries(
        rows, sides["terms"], sides["authors"], sides["labels"], site_settings
    )
    text = index.site_index(entries, rows, sides["sites"], site_settings).first().content
    assert text == f"""# Site

> About it

> Website: {SITE}
> Contact: me@x.org

---

## Product

### 1. Test Post

Body

- **Published:** January 2, 2024
- **Read More:** [{SITE}/product/test-post-2/]({SITE}/product/test-post-2/)

## Posts

### 1. First & best

Test excerpt

- **Published:** January 1, 2024
- **Categories:** News, Technology
- **Author:** Ann
- **Read More:** [{SITE}/post/test-post-1/]({SITE}/post/test-post-1/)

---

## Quick Links

- [Home]({SITE})
- [About Us]({SITE}/page/about/)
"""
    unlimited = index.listing_rows(
        rows, sides["terms"], sides["authors"], sides["labels"], site_settings
    )
    assert sorted((r.label, r.section, r.position) for r in unlimited.collect()) == [
        ("Posts", 2, 1), ("Product", 1, 1)
    ]


def test_empty_site_keeps_header_and_links(make, sides):
    nothing = make("CONTENT", [])
    site_settings = settings_of(make)
    entries = index.index_entries(
        nothing, sides["terms"], sides["authors"], sides["labels"], ["post"]
    )
    text = index.site_index(entries, nothing, sides["sites"], site_settings).first().content
    assert text.startswith("# Site\n") and text.endswith(f"- [Home]({SITE})\n")
    assert "###" not in text


def test_hooks(make, sides):
    rows = make("CONTENT", [post(1), post(2, title="Hidden")])
    entries = index.index_entries(
        rows, sides["terms"], sides["authors"], sides["labels"], ["post"],
        query_hook=lambda d: d.filter(F.col("title") != "Hidden"),
        entry_hook=lambda e: F.replace(e, F.lit("- **Read"), F.lit("- **Price:** 5\n- **Read")),
    )
    assert [("- **Price:** 5\n- **Read More" in r.entry) for r in entries.collect()] == [True]
    site_settings = settings_of(make)
    document = index.site_index(
        entries, rows, sides["sites"], site_settings, lambda d: F.concat(d, F.lit("\nMore"))
    )
    assert document.first().content.endswith("\nMore")


def test_page_document(make, sides):
    rows = make("CONTENT", [post(1, content="<h2>Hi</h2><p>there</p>")])
    text = detail.page_documents(
        rows, sides["terms"], sides["authors"], sides["media"], sides["sites"]
    ).first().content
    assert text == f"""# Test Post

## Hi
there

---

## Details

- **Published:** January 1, 2024
- **Last Updated:** January 1, 2024
- **Author:** [Ann]({SITE}/author/1/)
- **Categories:** News, Technology
- **Permalink:** [{SITE}/post/test-post-1/]({SITE}/post/test-post-1/)

## Featured Image

![Alt]({SITE}/i.jpg)

---

*From [Site]({SITE})*"""


def requests_of(make, paths, **kw):
    names = schemas.REQUESTS.fieldNames()
    fixed = {"site_id": "s", "ts": datetime(2024, 1, 1), "peer": "1.2.3.4"} | kw
    return make("REQUESTS", [
        tuple({"request_id": i, "path": p}.get(n, fixed.get(n)) for n in names)
        for i, p in enumerate(paths)
    ])


def test_outcomes_in_order(make):
    rows = make("CONTENT", [post(1, slug="hello"), post(2, post_type="page", slug="about")])
    paths = ["/llms.txt", "/ai/content/post/hello", "/ai/content/post/hello/", "/ai/content/***/x",
             "/ai/content/post/0", "/ai/content/secret/hello", "/ai/content/post/none",
             "/ai/content/about", "/ai/content/none", "/elsewhere"]

    def verdicts(**kw):
        got = routing.outcomes(requests_of(make, paths), rows, settings_of(make, **kw))
        return {r.request_id: (r.status, r.reason) for r in got.collect()}

    assert verdicts() == {
        0: (200, "ok"), 1: (200, "ok"), 2: (200, "ok"), 3: (400, "missing part"),
        4: (400, "missing part"), 5: (404, "no item"), 6: (404, "no item"), 7: (200, "ok"),
        8: (404, "no page"),
    }
    assert set(verdicts(enabled="0").values()) == {(404, "disabled")}
    off = verdicts(item_endpoints_enabled="0", index_enabled="0")
    assert off[0] == (404, "index off") and off[1] == off[7] == (404, "items off")


def test_limited_requests_and_their_text(make):
    got = routing.outcomes(
        requests_of(make, ["/llms.txt"] * 12), make("CONTENT", []),
        settings_of(make, limit_requests=10),
    )
    rows = routing.response_headers(got).orderBy("request_id").collect()
    assert [r.status for r in rows] == [200] * 10 + [429] * 2
    assert (rows[0].header_remaining, rows[9].header_remaining, rows[11].retry_after) == (9, 0, 60)
    text = routing.error_documents(got, service="Docs").first().content
    assert text.startswith("# 429 Too Many Requests\n\n") and text.endswith("---\n\n*Docs*\n")
    assert "- **Maximum requests:** 10 per 60 seconds\n" in text


def test_redirects(make):
    rows = make("CONTENT", [post(1, slug="hello"), post(2, post_type="page", slug="home")])
    paths = ["/post/hello/", "/", "/tag/x/", "/llms.txt"]
    requests = requests_of(make, paths, user_agent="GPTBot/1.0")
    site_settings = settings_of(make)

    def targets(front):
        sites = make("SITES", [("s", "Site", "", SITE, "", front)])
        routed = routing.with_site_settings(routing.with_route(requests), site_settings)
        got = routing.redirects(routed, rows, sites, site_settings).collect()
        return {r.request_id: r.target for r in got}

    item = f"{SITE}/ai/content/post/hello"
    assert targets(None) == {0: item, 1: f"{SITE}/llms.txt", 2: None}
    assert targets(2) == {0: item, 1: f"{SITE}/ai/content/page/home", 2: None}


def test_stale_keys(make):
    rows = make("CONTENT", [post(1, slug="hello"), post(2)])
    log = make("CONTENT_CHANGES", [
        (1, datetime(2024, 1, 1), "s", 1, "save", None, None, False, False),
        (2, datetime(2024, 1, 1), "s", 1, "save", None, None, False, False),
        (3, datetime(2024, 1, 1), "s", 2, "save", None, None, True, False),
        (4, datetime(2024, 1, 1), "s", 2, "transition", "draft", "pending", False, False),
        (5, datetime(2024, 1, 1), "s", 9, "delete", None, None, False, False),
    ])
    keys = changes.stale_keys(log, rows, settings_of(make)).collect()
    assert sorted(k.artifact_key[:18] for k in keys) == [
        "content_post_1", "content_post_hello", "listing_" + keys_md5()[:10]
    ]


def keys_md5():
    import hashlib

    return hashlib.md5(b"post,page").hexdigest()


def test_no_limit_means_all(make, sides):
    rows = make("CONTENT", [post(i) for i in range(620)] + [post(900, post_type="page", slug="p")])
    top = content.newest_published(rows, ["post", "page"], limit=-1).collect()
    assert sorted(r.site_rank for r in top) == list(range(1, 622))
    assert {r.post_id: r.site_rank for r in top}[900] == 1
    entries = index.index_entries(
        rows, sides["terms"], sides["authors"], sides["labels"], ["post", "page"], limit=-1
    ).collect()
    assert sorted((r.label, r.position) for r in entries) == sorted(
        [("Pages", 1)] + [("Posts", i) for i in range(1, 621)]
    )
    assert {r.label: r.section_order for r in entries} == {"Pages": 1, "Posts": 2}


def test_a_null_override_falls_through(make, spark):
    rows = make("CONTENT", [post(2, post_type="page", slug="about")])
    texts = [("s", "about", None), ("s", "fixed", "Text"), ("s", "empty", "")]
    overrides = spark.createDataFrame(texts, "site_id string, route_page string, content string")
    paths = ["/ai/content/about", "/ai/content/fixed", "/ai/content/empty"]
    got = routing.outcomes(requests_of(make, paths), rows, settings_of(make), overrides=overrides)
    assert {r.request_id: r.status for r in got.collect()} == {0: 200, 1: 200, 2: 404}


def test_changes_may_carry_what_was_deleted(make):
    log = make("CONTENT_CHANGES", [(5, datetime(2024, 1, 1), "s", 9, "delete", None, None, False, False)])
    told = log.withColumn("post_type", F.lit("post")).withColumn("slug", F.lit("gone"))
    keys = changes.stale_keys(told, make("CONTENT", []), settings_of(make)).collect()
    assert {k.artifact_key for k in keys} == {"content_post_9", "content_post_gone", f"listing_{keys_md5()}"}


def test_bodies_travel_at_most_once(spark, make, sides):
    """With all sides too large to broadcast, no exchange has HTML and one has the Markdown."""
    rows = make("CONTENT", [post(1, content="<p>x</p>")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pages = detail.page_documents(rows, sides["terms"], sides["authors"], sides["media"], sides["sites"])
        plan = spark._jvm.PythonSQLUtils.explainString(pages._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    inputs = [part.split("\n")[1] for part in plan.split("\n\n") if ") Exchange" in part.split("\n")[0]]
    assert len(inputs) > 3
    assert not [x for x in inputs if "content#" in x]
    assert len([x for x in inputs if "body#" in x]) == 1


def test_snapshots_give_a_change_feed(make):
    before = make("CONTENT", [post(1), post(2), post(3, status="draft"), post(4, slug="old"), post(5), post(6)])
    after = make("CONTENT", [post(1), post(2, content="new"), post(3), post(4, slug="new"), post(6, status="trash"), post(7), post(7)])
    feed = changes.snapshot_changes(before, after, F.timestamp_seconds(F.lit(9)))
    got = [(r.post_id, r.event, r.slug, r.old_status, r.new_status) for r in feed.collect()]
    assert sorted(got) == sorted([
        (2, "save", "test-post-2", "publish", "publish"), (3, "transition", "test-post-3", "draft", "publish"),
        (4, "delete", "old", "publish", "publish"), (4, "save", "new", "publish", "publish"),
        (5, "delete", "test-post-5", "publish", None), (6, "transition", "test-post-6", "publish", "trash"),
        (7, "save", "test-post-7", None, "publish"),
    ])
    keys = {k.artifact_key for k in changes.stale_keys(feed, after, settings_of(make)).collect()}
    assert {"content_post_old", "content_post_new", "content_post_test-post-5"} <= keys and "content_post_1" not in keys
    assert changes.snapshot_changes(after, after, F.current_timestamp()).collect() == []


def test_bodies_stay_out_of_the_diff(spark, make):
    rows = make("CONTENT", [post(1)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        feed = changes.snapshot_changes(rows, rows, F.current_timestamp())
        plan = spark._jvm.PythonSQLUtils.explainString(feed._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    inputs = [part.split("\n")[1] for part in plan.split("\n\n") if ") Exchange" in part.split("\n")[0]]
    assert len(inputs) == 2 and not [x for x in inputs if "content#" in x]


def test_endpoints_named_by_parameters(make):
    rows = make("CONTENT", [post(1, slug="hello"), post(2, post_type="page", slug="about")])
    paths = ["/?endpoint=index", "/index.php?a=b&endpoint=item&type=Post&slug=Hello", "/?endpoint=item&type=post", "/?endpoint=page&page=about",
             "/?endpoint=feed", "/?endpoint=", "/?x=endpoint", "/other?endpoint=index"]
    got = routing.outcomes(requests_of(make, paths), rows, settings_of(make)).collect()
    assert {r.request_id: (r.status, r.reason) for r in got} == {
        0: (200, "ok"), 1: (200, "ok"), 2: (400, "missing part"), 3: (200, "ok"), 4: (404, "unknown"),
    }
    text = routing.error_documents(routing.outcomes(requests_of(make, paths[4:5]), rows, settings_of(make))).first().content
    assert "Unknown endpoint." in text


def test_item_hook_hides_items(make):
    rows = make("CONTENT", [post(1, slug="hello")])
    got = routing.outcomes(requests_of(make, ["/ai/content/post/hello"]), rows, settings_of(make), item_hook=lambda d: d.filter("post_id > 1"))
    assert [r.reason for r in got.collect()] == ["no item"]


def test_text_hooks_of_a_page(make, sides):
    rows = make("CONTENT", [post(1, content="<p>there</p>")])
    text = detail.page_documents(
        rows, sides["terms"], sides["authors"], sides["media"], sides["sites"],
        content_hook=lambda c: F.replace(c, F.lit("there"), F.lit("<b>here</b>")), document_hook=lambda d: F.concat(d, F.lit("\nMore")),
    ).first().content
    assert "**here**" in text and text.endswith("*\nMore")
