"""From the rows of four dump tables to a multigraph of page links.

All inputs have text columns, so that namespaces are compared before anything is cast; ids are longs from then on. Where
a key occurs more than once, the last row in file order stays (by _pos, or by the id where a table has no _pos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dump_text import strict_unsigned

MODES = ("reference", "transitive")
MOST_HOPS = 10


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the last by order: an aggregate, so each task sends one row a key."""
    rest = [c for c in df.columns if c not in (key, order)]
    last = F.max_by(F.struct(*rest), F.col(order)) if rest else F.lit(None)
    return df.groupBy(key).agg(last.alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def _order(df: DataFrame, other: str) -> Column:
    return F.col("_pos") if "_pos" in df.columns else F.col(other)


def _in_main(namespace: str) -> Column:
    """The article namespace, by its exact text."""
    return F.col(namespace) == "0"


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, page_title, is_redirect of the article namespace; the last of each title."""
    rows = pages.where(_in_main("page_namespace")).select(strict_unsigned(F.col("page_id"), "page_id").alias("page_id"), "page_title", (F.col("page_is_redirect") == "1").alias("is_redirect"), *(["_pos"] if "_pos" in pages.columns else []))
    return keep_last(rows.withColumn("_order", _order(rows, "page_id")).drop("_pos"), "page_title", "_order")


def linktarget_rows(targets: DataFrame) -> DataFrame:
    """lt_id, lt_title of the article namespace; the last of each id."""
    rows = targets.where(_in_main("lt_namespace")).select(strict_unsigned(F.col("lt_id"), "lt_id").alias("lt_id"), "lt_title", *(["_pos"] if "_pos" in targets.columns else []))
    return keep_last(rows.withColumn("_order", _order(rows, "lt_title")).drop("_pos"), "lt_id", "_order")


def all_redirects(redirects: DataFrame, pages: DataFrame) -> DataFrame:
    """rd_from, rd_title, target_id, target_is_redirect of redirects whose target is an article."""
    rows = redirects.where(_in_main("rd_namespace")).join(pages.select(F.col("page_title").alias("rd_title"), F.col("page_id").alias("target_id"), F.col("is_redirect").alias("target_is_redirect")), "rd_title")
    return rows.withColumn("rd_from", strict_unsigned(F.col("rd_from"), "rd_from"))


def redirect_rows(redirects: DataFrame, pages: DataFrame) -> DataFrame:
    """rd_from, rd_title, target_id of redirects to a page that is none itself; the last of each rd_from."""
    rows = all_redirects(redirects, pages).where(~F.col("target_is_redirect"))
    rows = rows.withColumn("_order", _order(rows, "rd_title")).select("rd_from", "rd_title", "target_id", "_order")
    return keep_last(rows, "rd_from", "_order")


def resolved_links(links: DataFrame, targets: DataFrame, pages: DataFrame) -> DataFrame:
    """src, target_id, is_redirect of links from the article namespace to a page there.

    The source needn't be a page. It is cast only for links that have a target, as a link without one may hold anything.
    """
    rows = links.where(_in_main("pl_from_namespace")).select("pl_from", strict_unsigned(F.col("pl_target_id"), "pl_target_id").alias("lt_id"))
    found = rows.join(targets, "lt_id").join(pages.select(F.col("page_title").alias("lt_title"), F.col("page_id").alias("target_id"), "is_redirect"), "lt_title")
    return found.select(strict_unsigned(F.col("pl_from"), "pl_from").alias("src"), "target_id", "is_redirect")


def _second_hops(kept: DataFrame) -> DataFrame:
    """Page id to the id two redirects on: a redirect's target has to have a redirect row of its own."""
    first = kept.select(F.col("rd_from").alias("target_id"), F.col("target_id").alias("via"))
    second = kept.select(F.col("rd_from").alias("via"), F.col("target_id").alias("dst"))
    return first.join(second, "via").select("target_id", "dst")


def _chains(everything: DataFrame) -> DataFrame:
    """Redirect page id to the article at the end of its chain, of at most MOST_HOPS redirects; plain joins, a hop each."""
    order = _order(everything, "rd_title")
    table = keep_last(everything.withColumn("_order", order).select("rd_from", "target_id", "target_is_redirect", "_order"), "rd_from", "_order")
    step = table.select(F.col("rd_from").alias("_at"), F.col("target_id").alias("_next"), F.col("target_is_redirect").alias("_open"))
    open_, ends = table.select("rd_from", "target_id", "target_is_redirect"), None
    for hop in range(MOST_HOPS):
        done = open_.where(~F.col("target_is_redirect")).select(F.col("rd_from").alias("target_id"), F.col("target_id").alias("dst"))
        ends = done if ends is None else ends.unionByName(done)
        if hop + 1 < MOST_HOPS:
            open_ = open_.where("target_is_redirect").join(step, F.col("target_id") == F.col("_at")).select("rd_from", F.col("_next").alias("target_id"), F.col("_open").alias("target_is_redirect"))
    return ends


def edges(pages: DataFrame, redirects: DataFrame, targets: DataFrame, links: DataFrame, mode: str = "reference") -> DataFrame:
    """src, dst: every link to an article, and links to redirect pages as the mode resolves them; duplicates stay.

    reference: a link to a redirect page counts only if the redirect's target has a redirect row itself, and then leads
    to that row's target. transitive: it leads to the article at the end of the redirects.
    """
    if mode not in MODES:
        raise ValueError(f"mode is {mode!r}, not one of {', '.join(MODES)}")
    page, target = page_rows(pages), linktarget_rows(targets)
    found = resolved_links(links, target, page)
    direct = found.where(~F.col("is_redirect")).select("src", F.col("target_id").alias("dst"))
    ends = _second_hops(redirect_rows(redirects, page)) if mode == "reference" else _chains(all_redirects(redirects, page))
    return direct.unionByName(found.where("is_redirect").join(ends, "target_id").select("src", "dst"))


def vertices(pages: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """page_id of all article pages and all sources of edges."""
    return page_rows(pages).select("page_id").union(edge_rows.select("src")).distinct()


def link_counts(pages: DataFrame, redirects: DataFrame, targets: DataFrame, links: DataFrame, mode: str = "reference") -> DataFrame:
    """One row: links that were read, links to a page (before redirects are resolved), and links that are kept."""
    found = resolved_links(links, linktarget_rows(targets), page_rows(pages))
    sides = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in (("read", links), ("resolved", found), ("kept", edges(pages, redirects, targets, links, mode)))]
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2])
    return rows.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in ("read", "resolved", "kept")])
