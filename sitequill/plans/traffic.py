"""One pass over a request log: redirects, outcomes and the events that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequill.operators.limits import ANCHORED
from sitequill.operators.routing import (
    outcomes,
    redirects,
    response_headers,
    with_route,
    with_site_settings,
)
from sitequill.plans.tables import Tables
from sitequill.sources.tables import write_events


def analyse(
    requests: DataFrame, tables: Tables, out: str, mode: str = ANCHORED, run: str | int = 0
) -> dict[str, str]:
    """Write verdicts, redirects and limit events as parquet; returns the paths.

    ``run`` names the log, for example its day; the same run again replaces its rows.
    """
    paths = {name: f"{out}/{name}" for name in ("verdicts", "redirects", "limit_events")}
    folder = f"run={run}"
    verdicts = response_headers(outcomes(requests, tables.content, tables.settings, mode=mode))
    verdicts.drop("trusted_proxies", "custom_agents", "post_types").write.mode(
        "overwrite"
    ).parquet(f"{paths['verdicts']}/{folder}")
    routed = with_site_settings(with_route(requests), tables.settings)
    redirects(routed, tables.content, tables.sites, tables.settings).write.mode(
        "overwrite"
    ).parquet(f"{paths['redirects']}/{folder}")
    # Read back what was written, so the verdicts are computed once.
    written = requests.sparkSession.read.parquet(f"{paths['verdicts']}/{folder}")
    blocked = written.filter(F.col("limited"))
    write_events(
        blocked.select("request_id", "site_id", "ts", "client_ip", "request_count",
                       F.col("limit_requests").alias("max_requests")),
        paths["limit_events"],
        run,
    )
    return paths
