"""Site-type detection as a feature job, and the per-site render plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.urls import WS, let, trim_ws

# Render modes accepted by the seed table.
RENDER_ON = ("on", "yes", "true")
RENDER_OFF = ("off", "no", "false")
# An id attribute with one of the roots' ids, inside a tag's attributes.
ROOT_ID_RE = ("[" + WS + "/]id[" + WS + "]*+=[" + WS + "]*+(?:\"(?:IDS)\"|'(?:IDS)'|(?:IDS)(?:[" + WS + "/]|$))").replace("IDS", "|".join(H.SPA_ROOT_IDS))


def count_of(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


# Patterns take the rest of the document where an element does not end (see functions/html.py).
RAW_TEXT_RE = r"(?is)<(?:script|style)(?:[\s/][^>]*+)?+(?:>((?:[^<]++|<(?!/(?:script|style)\s*+>))*+)(?:</(?:script|style)\s*+>|\z)|\z)"
BODY_RE = rf"(?is)<body(?=[{WS}/>])[^>]*+(?:>(.*+)|\z)"
HEAD_RE = rf"(?is)<head(?=[{WS}/>])[^>]*+>(?:[^<]++|<(?!/head[{WS}]*+>))*+</head[{WS}]*+>|(<head(?=[{WS}/>]).*+)"


def body_text_bytes(html: Column) -> Column:
    """Trimmed byte length of the body's text. The text of script and style
    elements counts whole, whatever signs it holds, and is not decoded."""
    def run(h):
        body = F.when(h.rlike(f"(?i)<body[{WS}/>]"), F.regexp_extract(h, BODY_RE, 1)).otherwise(F.regexp_replace(h, HEAD_RE, "$1"))
        return let(F.regexp_replace(body, r"(?s)<!--(?:[^-]++|-(?!->))*+(?:-->|\z)", ""), text)

    def text(b):
        outside = F.transform(F.split(b, RAW_TEXT_RE), lambda p: H.decode_entities(H.visible_text(p), in_text=True))
        raw = F.regexp_extract_all(b, F.lit(RAW_TEXT_RE), 1)
        whole = F.array_join(F.zip_with(outside, raw, lambda p, r: F.concat(F.coalesce(p, F.lit("")), F.coalesce(r, F.lit("")))), "")
        return F.octet_length(trim_ws(whole))
    return let(html, run)


def spa_features(pages: DataFrame, html_col: str = "html") -> DataFrame:
    html = F.col(html_col)
    lower = F.lower(html)
    marker = F.lit(False)
    for m in H.SPA_MARKERS:
        marker = marker | lower.contains(m)
    return (pages
            .withColumn("has_marker", marker)
            .withColumn("module_scripts", count_of(lower, 'type="module"') + count_of(lower, "type='module'"))
            .withColumn("scripts", count_of(lower, "<script"))
            .withColumn("has_root_id", F.exists(H.all_attrs(H.blank_markup(html)), lambda a: a.rlike(ROOT_ID_RE)))
            .withColumn("body_text_bytes", body_text_bytes(html)))


def spa_verdict() -> Column:
    return (F.col("has_marker")
            | (F.col("has_root_id") & (F.col("module_scripts") >= 1) & (F.col("body_text_bytes") < 500))
            | ((F.col("scripts") >= 3) & (F.col("body_text_bytes") < 200) & (F.col("module_scripts") >= 1)))


def spa_shell(html: Column) -> Column:
    """Second heuristic: mount point, a script, and under 200 visible
    non-white-space characters."""
    lower = F.lower(html)
    mount = F.lit(False)
    for m in H.SPA_MOUNT_MARKERS:
        mount = mount | lower.contains(m)
    visible = F.length(F.regexp_replace(H.visible_text(lower), f"[{WS}]", ""))
    return mount & lower.contains("<script") & (visible < 200)


def render_plan(seeds: DataFrame, captures: DataFrame) -> DataFrame:
    """seeds(site, seed_url, mode) + captures -> (site, seed_url, mode, render).
    on/yes/true renders, off/no/false does not, anything else uses the
    verdict of the seed page's latest capture (a missing or non-200 one: no). One
    row per seed, however often its page was captured. The features are narrow,
    so the latest of them is taken by an aggregate that moves no body."""
    pages = captures.where(F.col("status") == 200).select(U.normalize_url(F.col("url")).alias("_k"), F.col("body").alias("html"), "seq")
    verdicts = spa_features(pages).select("_k", "seq", spa_verdict().alias("_verdict"))
    latest = verdicts.groupBy("_k").agg(F.max_by("_verdict", F.struct("seq", "_verdict")).alias("_verdict"))
    s = seeds.withColumn("_k", U.normalize_url(F.col("seed_url"))).withColumn("_m", F.lower(F.col("mode")))
    render = (F.when(F.col("_m").isin(*RENDER_ON), F.lit(True))
              .when(F.col("_m").isin(*RENDER_OFF), F.lit(False))
              .otherwise(F.coalesce(F.col("_verdict"), F.lit(False))))
    return s.join(latest, "_k", "left").select("site", "seed_url", "mode", render.alias("render"))
