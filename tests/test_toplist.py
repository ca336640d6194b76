import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitequill.operators import toplist
from sitequill.operators.content import ranked
from sitequill.operators.index import LISTED, listing_source
from sitequill.session import cut_lineage
from sitequill.sources import schemas

START = datetime(2024, 1, 1)
TYPES = ["post", "page"]


def post(site, post_id, hour, status="publish", post_type="post", title="t"):
    row = {
        "site_id": site, "post_id": post_id, "post_type": post_type, "status": status, "slug": f"p{post_id}", "title": title,
        "excerpt": "", "content": f"<p>{title}</p>", "author_id": 1, "published_at": START + timedelta(hours=hour),
        "modified_at": START, "permalink": f"https://{site}/p{post_id}/",
    }
    return tuple(row[f] for f in schemas.CONTENT.fieldNames())


@pytest.fixture(scope="module")
def make(spark):
    def build(rows):
        return spark.createDataFrame(rows, schemas.CONTENT)

    return build


def seen(rows, limit):
    return sorted(tuple(r) for r in rows.filter(F.col("site_rank") <= limit).select(*LISTED, "site_rank").collect())


def feed_of(spark, keys):
    return spark.createDataFrame(list(keys), "site_id string, post_id long")


def test_follows_many_changes(spark, make):
    """Rounds of random changes, times with many ties, against a full selection each time."""
    draw, limit, margin = random.Random(5), 4, 2
    now = {(s, i): post(s, i, draw.randrange(12)) for s in "abcd" for i in range(20)}
    now |= {("e", 1): post("e", 1, 3), ("f", 1): post("f", 1, 1, status="draft")}
    stored = cut_lineage(toplist.first_rows(make(list(now.values())), TYPES, limit, margin), "top")
    for _ in range(2):
        changed = set()
        for _ in range(40):
            key = (draw.choice("aabcefg"), draw.randrange(26))
            changed.add(key)
            if draw.random() < 0.5:
                now.pop(key, None)
            else:
                now[key] = post(*key, draw.randrange(14), draw.choice(["publish", "publish", "draft"]), draw.choice(["post", "page", "other"]), str(draw.random()))
        content = make(list(now.values()))
        stored = cut_lineage(toplist.followed(stored, feed_of(spark, changed), content, TYPES, limit, margin), "top")
        assert seen(stored, limit) == seen(ranked(listing_source(content, TYPES), limit), limit)


def test_content_is_read_only_where_the_margin_is_used_up(spark, make):
    rows = [post(s, i, i) for s in "ab" for i in range(10)]
    stored = cut_lineage(toplist.first_rows(make(rows), TYPES, 3, 2), "top")
    gone = {("a", 9), ("b", 9), ("b", 8), ("b", 7)}
    feed = feed_of(spark, gone | {("a", 99)})
    # Of site a only the changed post is there; site b has lost more than its margin.
    left = [r for r in rows if r[0] == "b" and ("b", r[1]) not in gone] + [post("a", 99, 99)]
    got = toplist.followed(stored, feed, make(left), TYPES, 3, 2)
    assert [(r.site_id, r.post_id) for r in got.orderBy("site_id", "site_rank").filter("site_rank <= 3").collect()] == [
        ("a", 99), ("a", 8), ("a", 7), ("b", 6), ("b", 5), ("b", 4)]


def test_all_rows_gone_and_types_changed(spark, make):
    rows = [post("a", i, i) for i in range(9)] + [post("b", i, i, post_type="page") for i in range(2)]
    stored = cut_lineage(toplist.first_rows(make(rows), ["post"], 2, 1), "top")
    later = make(rows[:6] + rows[9:])
    feed = feed_of(spark, [("a", 6), ("a", 7), ("a", 8)])
    got = toplist.followed(stored, feed, later, TYPES, 2, 1, again=spark.createDataFrame([("b",)], "site_id string"))
    assert [(r.site_id, r.post_id, r.more) for r in got.orderBy("site_id", "site_rank").collect()] == [
        ("a", 5, True), ("a", 4, True), ("a", 3, True), ("b", 1, False), ("b", 0, False)]


def test_empty_tables(spark, make):
    empty = make([])
    stored = cut_lineage(toplist.first_rows(empty, TYPES), "top")
    assert stored.count() == 0
    assert toplist.followed(stored, feed_of(spark, []), empty, TYPES).count() == 0
    first = toplist.followed(stored, feed_of(spark, [("a", 1)]), make([post("a", 1, 1)]), TYPES)
    assert [(r.post_id, r.site_rank, r.more) for r in first.collect()] == [(1, 1, False)]
