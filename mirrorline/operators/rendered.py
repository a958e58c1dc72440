"""The rendered run: what a browser's pages ask for next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from .extract import extract_nav_links, rendered_requests
from .robots import noise_filter, route_filter


def _with_place(links: DataFrame) -> DataFrame:
    u = links.select(U.parsed("dst_url").alias("u"), "dst_url", "site")
    return u.select("site", F.col("dst_url").alias("url"), F.col("u.host").alias("host"), F.col("u.path").alias("path"))


def rendered_frontier(rendered: DataFrame, entries: DataFrame) -> DataFrame:
    """(site, url, kind) to fetch after rendering: kind 'asset' for requested
    URLs that are not noise, 'route' for navigation links that look like pages;
    a URL that is both is a route. URLs with a manifest entry are left out."""
    assets = noise_filter(_with_place(rendered_requests(rendered))).select("site", "url", F.lit("asset").alias("kind"))
    routes = route_filter(_with_place(extract_nav_links(rendered))).select("site", "url", F.lit("route").alias("kind"))
    found = assets.unionByName(routes).groupBy("site", "url").agg(F.max("kind").alias("kind"))
    return found.join(entries.select("site", "url"), ["site", "url"], "left_anti")
