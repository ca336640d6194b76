"""Whole jobs on tables written to disk and read back with their schemas."""

import os
import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sitequill.functions.text import ITEM_PREFIX
from sitequill.operators.content import listable_types
from sitequill.plans import rebuild, traffic
from sitequill.plans.tables import SITE_BUCKETS, Tables, site_bucket, write_by_site
from sitequill.session import work_folder
from sitequill.sources import sample, schemas
from sitequill.sources.artifacts import append_artifacts, merge_artifacts, read_artifacts, remove_merged, stored_artifacts
from sitequill.sources.tables import read_table, write_documents

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample data")


@pytest.fixture(scope="module")
def stored(spark):
    root = work_folder(spark, "test-tables")
    for name in ("content", "terms", "authors", "media", "sites", "site_settings", "requests"):
        rows = getattr(sample, name)(spark, SF)
        rows.select(*schemas.TABLES[name].fieldNames()).write.parquet(f"{root}/{name}")
    sample.type_labels(spark).write.parquet(f"{root}/type_labels")
    return root


def test_render_change_and_clear(spark, stored):
    tables = Tables.read(spark, stored)
    path = f"{stored}/artifacts"
    rebuild.render_all(tables, path, F.timestamp_seconds(F.lit(1000)))
    first = read_artifacts(spark, path)
    sites = tables.sites.count()
    assert first.filter("kind = 'listing'").count() == sites
    items = first.filter("kind = 'item'").count()
    assert items > 0 and first.count() == items + sites

    post = tables.content.filter("status = 'publish' AND post_type = 'post'").first()
    change = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), post.site_id, post.post_id, "save", None, None, False, False)],
        schemas.CONTENT_CHANGES,
    )
    later = F.timestamp_seconds(F.lit(1010))
    batch = rebuild.rebuilt(tables, change, first, later)
    assert [(r.kind, r.artifact_key) for r in batch.orderBy("kind").collect()][0] == (
        "item", f"content_post_{post.slug}"
    )
    assert {(r.written, r.removed) for r in rebuild.summary(batch).collect()} == {(1, 0)}

    rebuild.clear_kind(first, ITEM_PREFIX, path, F.timestamp_seconds(F.lit(1020)), "clear")
    assert read_artifacts(spark, path).count() == sites


def test_traffic_job(spark, stored):
    tables = Tables.read(spark, stored)
    requests = read_table(spark, "requests", f"{stored}/requests")
    paths = [traffic.analyse(requests, tables, f"{stored}/out") for _ in range(2)][1]
    verdicts = spark.read.parquet(paths["verdicts"])
    asked = requests.filter(F.col("path").rlike("^/(llms[.]txt|ai/content/)")).count()
    assert verdicts.count() == asked
    blocked = spark.read.parquet(paths["limit_events"]).count()
    assert blocked == verdicts.filter("status = 429").count() + verdicts.filter(
        "limited AND NOT enabled"
    ).count()
    assert spark.read.parquet(paths["redirects"]).filter("status = 307").count() > 0


def test_documents_sink(spark, stored):
    rows = spark.createDataFrame([("s", "/llms.txt", "# S")], "site_id string, path string, content string")
    write_documents(rows, f"{stored}/documents")
    assert spark.read.parquet(f"{stored}/documents").first().content == "# S"


def test_listable_types(spark):
    assert {r.post_type for r in listable_types(sample.type_labels(spark)).collect()} == {"post", "page"}


def _batch(spark, made, rows):
    return spark.createDataFrame(
        [("s", k, "item", text, datetime.fromtimestamp(made, timezone.utc), 300, None) for k, text in rows], schemas.ARTIFACTS
    )


def _texts(frame):
    return sorted((r.artifact_key, r.content) for r in frame.collect())


def test_store_before_and_after_merging(spark):
    path = work_folder(spark, "test-store")
    later = F.timestamp_seconds(F.lit(2000))
    append_artifacts(_batch(spark, 1000, [("a", "a0"), ("b", "b0"), ("c", "c0"), ("d", "d0")]), path, 0, buckets=4)
    append_artifacts(_batch(spark, 1000, [("a", "a1"), ("b", None)]), path, 1)
    append_artifacts(_batch(spark, 1000, [("c", "c10")]), path, "stream-10")
    append_artifacts(_batch(spark, 1000, [("c", "c9")]), path, "stream-9")
    want = [("a", "a1"), ("c", "c10"), ("d", "d0")]
    assert _texts(read_artifacts(spark, path)) == want
    assert merge_artifacts(spark, path, F.timestamp_seconds(F.lit(1100))) == 1
    assert _texts(read_artifacts(spark, path)) == want
    # The removed key is kept for its lifetime, then dropped.
    assert ("b", None) in _texts(stored_artifacts(spark, path))
    append_artifacts(_batch(spark, 900, [("a", "older")]), path, 2)
    append_artifacts(_batch(spark, 1500, [("d", "d3"), ("e", "e3")]), path, 3)
    # A merged batch that runs again changes nothing, whatever it writes.
    append_artifacts(_batch(spark, 3000, [("a", "again")]), path, 0)
    want = [("a", "a1"), ("c", "c10"), ("d", "d3"), ("e", "e3")]
    assert _texts(read_artifacts(spark, path)) == want
    assert merge_artifacts(spark, path, later) == 2
    assert _texts(stored_artifacts(spark, path)) == want
    remove_merged(spark, path)
    assert _texts(read_artifacts(spark, path)) == want
    assert not os.path.exists(f"{path}/base/version=1") and not [x for x in os.listdir(f"{path}/delta") if x.startswith("batch=")]
    append_artifacts(_batch(spark, 2500, [("a", None)]), path, 4)
    assert _texts(read_artifacts(spark, path)) == want[1:]


def test_readers_and_merging_exchange_nothing(spark):
    path = work_folder(spark, "test-store-plan")
    append_artifacts(_batch(spark, 1000, [(f"k{i}", "x") for i in range(50)]), path, 0, buckets=4)
    merge_artifacts(spark, path, F.timestamp_seconds(F.lit(1000)))
    append_artifacts(_batch(spark, 1001, [(f"k{i}", "y") for i in range(25)]), path, 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = read_artifacts(spark, path)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.content for r in rows.collect()) == ["x"] * 25 + ["y"] * 25
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ShuffledHashJoin") == 3 and "Exchange" not in plan


def test_only_touched_sites_are_read(spark, stored):
    """Content, terms and media are scanned in the folders of the touched site; the rows stay the same."""
    plain, root = Tables.read(spark, stored), work_folder(spark, "test-by-site")
    for name in ("content", "terms", "media"):
        write_by_site(getattr(plain, name), f"{root}/{name}")
    for name in ("authors", "sites", "type_labels", "site_settings"):
        read_table(spark, name, f"{stored}/{name}").write.parquet(f"{root}/{name}")
    tables = Tables.read(spark, root)
    post = plain.content.filter("status = 'publish'").orderBy("post_id").first()
    change = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), post.site_id, post.post_id, "save", None, None, False, False)], schemas.CONTENT_CHANGES
    )
    touched = tables.touched(change)
    bucket = spark.range(1).select(site_bucket(F.lit(post.site_id))).first()[0]
    assert 0 <= bucket < SITE_BUCKETS
    for name in ("content", "terms", "media"):
        scanned = getattr(touched, name)
        plan = scanned._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"PartitionFilters: \[[^\]]*site_bucket#\d+ = {bucket}\)", plan)
    files = touched.content.select(F.input_file_name()).distinct().collect()
    assert files and all(f"site_bucket={bucket}/" in f[0] for f in files)
    now = F.timestamp_seconds(F.lit(1000))
    got, want = (rebuild.rebuilt(t, change, None, now).select("artifact_key", "source_hash").collect() for t in (tables, plain))
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 1
    # Writing one site again leaves the folders of the others alone.
    write_by_site(plain.terms.filter(F.col("site_id") == post.site_id).withColumn("name", F.lit("only")), f"{root}/terms")
    terms = Tables.read(spark, root).terms
    assert terms.filter("name <> 'only'").count() == plain.terms.filter(site_bucket(F.col("site_id")) != bucket).count()


def test_a_failed_rebuild_leaves_an_event(spark, stored):
    tables, root = Tables.read(spark, stored), work_folder(spark, "test-failed")
    append_artifacts(_batch(spark, 1000, [("a", "a0")]), f"{root}/store", 0)
    change = spark.createDataFrame([], schemas.CONTENT_CHANGES)
    now = F.timestamp_seconds(F.lit(2000))

    def broken(*_):
        raise RuntimeError("no disk")

    original, rebuild.append_artifacts = rebuild.append_artifacts, broken
    try:
        with pytest.raises(RuntimeError):
            rebuild.rebuild_stored(tables, change, f"{root}/store", now, 1, f"{root}/events")
    finally:
        rebuild.append_artifacts = original
    events = {(r.kind, r.event, r.message) for r in rebuild.read_events(spark, f"{root}/events").collect()}
    assert events == {("job", "before", None), ("item", "invalidated", None), ("job", "failed", "no disk")}


def test_item_hook_of_a_rebuild(spark, stored):
    tables = Tables.read(spark, stored)
    post = tables.content.filter("status = 'publish' AND post_type = 'post'").first()
    change = spark.createDataFrame(
        [(1, datetime(2024, 1, 1), post.site_id, post.post_id, "save", None, None, False, False)], schemas.CONTENT_CHANGES
    )
    hidden = rebuild.rebuilt(tables, change, None, F.timestamp_seconds(F.lit(1)), item_hook=lambda rows: rows.filter(F.col("post_id") != post.post_id))
    rows = {r.artifact_key: r.content for r in hidden.collect()}
    assert rows[f"content_post_{post.slug}"] is None
