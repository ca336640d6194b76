"""The tables a job works on."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequill.operators.settings import merge_settings
from sitequill.sources import sample
from sitequill.sources.tables import read_table


#: Folders that content, terms and media are dealt to by their site.
SITE_BUCKETS = 256
BUCKET = "site_bucket"
_BY_SITE = ("content", "terms", "media")


def site_bucket(site_id: Column) -> Column:
    return F.pmod(F.xxhash64(site_id), F.lit(SITE_BUCKETS)).cast("int")


def write_by_site(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a table into a folder per site bucket; with ``mode`` overwrite only folders that have rows are replaced."""
    bucketed = rows.withColumn(BUCKET, site_bucket(F.col("site_id"))).repartition(BUCKET)
    bucketed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


@dataclass(frozen=True)
class Tables:
    content: DataFrame
    terms: DataFrame
    authors: DataFrame
    media: DataFrame
    sites: DataFrame
    type_labels: DataFrame
    settings: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, root: str, fmt: str = "parquet") -> Tables:
        """Read ``root/<table>`` for every table; settings get their defaults."""
        get = lambda name: read_table(spark, name, f"{root}/{name}", fmt)
        return cls(
            *[get(n) for n in ("content", "terms", "authors", "media", "sites", "type_labels")],
            settings=merge_settings(get("site_settings")),
        )

    def touched(self, sites: DataFrame) -> Tables:
        """The tables cut down to what the given sites (site_id) need.

        Tables with site buckets are read only in the folders of these sites: at most SITE_BUCKETS
        numbers come to the driver. Narrow tables then lose the other sites of those folders;
        content doesn't, since its bodies would be shuffled for that.
        """
        sites = sites.select("site_id").distinct()
        buckets = [r[0] for r in sites.select(site_bucket(F.col("site_id"))).distinct().collect()]

        def of_buckets(name: str) -> DataFrame:
            rows = getattr(self, name)
            return rows.filter(F.col(BUCKET).isin(buckets)).drop(BUCKET) if BUCKET in rows.columns else rows

        found = {name: of_buckets(name) for name in _BY_SITE}
        for name in ("terms", "media"):
            found[name] = found[name].join(sites, "site_id", "left_semi")
        for name in ("sites", "settings"):
            found[name] = getattr(self, name).join(sites, "site_id", "left_semi")
        return replace(self, **found)

    def plain(self) -> Tables:
        """The tables without the column of the site buckets."""
        return replace(self, **{f.name: getattr(self, f.name).drop(BUCKET) for f in fields(self)})

    @classmethod
    def sample(cls, spark: SparkSession, sf_dir: str) -> Tables:
        return cls(
            content=sample.content(spark, sf_dir),
            terms=sample.terms(spark, sf_dir),
            authors=sample.authors(spark, sf_dir),
            media=sample.media(spark, sf_dir),
            sites=sample.sites(spark, sf_dir),
            type_labels=sample.type_labels(spark),
            settings=merge_settings(sample.site_settings(spark, sf_dir)),
        )
