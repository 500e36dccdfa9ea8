"""Pages to structured records.

``extract_pages`` is one projection over the page table: no shuffle, one scan.
Pages that regular expressions read exactly stay in the JVM; the others are
sent, and only they, to the tree helper.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions.text import clean_text, word_count
from pagemill.functions.urls import let, link_targets, resolve_url
from pagemill.operators.skew import exploded
from pagemill.operators.tree import RAW_TYPE, tree_fields
from pagemill.session import built_once

RECORD_COLUMNS = (
    "title", "content", "meta_description", "meta_keywords", "language", "author", "canonical_url",
    "word_count", "links", "images", "headings", "schema_org_data", "parse_error",
)


_FIELDS = ("title", "description", "keywords", "author", "language", "canonical", "headings", "content", "hrefs", "srcs", "microdata", "parse_error")
_META = ("description", "keywords", "author")


def _raw(name: str) -> Column:
    return F.col(f"_raw_{name}")


@built_once
def _reading_columns(html: str, choose: bool):
    stripped, main = F.col("_stripped"), F.col("_main")
    page = F.when(H.needs_tree(stripped, main), F.col(html)) if choose else F.lit(None).cast("string")
    by_regex = F.col("_tree_page").isNull() & stripped.isNotNull()
    return (
        H.strip_boilerplate(F.col(html)),
        H.main_element(stripped),
        page,
        H.start_tags(stripped),
        {f"_raw_{name}": F.when(by_regex, column) for name, column in H.raw_fields(stripped, H.main_inner(main), F.col("_tags")).items()},
        H.json_ld(F.col(html)),
    )


def _of_tree(name: str) -> Column:
    return F.col("_tree")["meta"][name] if name in _META else F.col("_tree")[name]


def with_raw_fields(pages: DataFrame, html: str = "html", mode: str = "auto") -> DataFrame:
    """Replaces the page by its pieces, ``_raw_`` and a name each, and ``_json_ld``.

    ``mode`` is 'sql', 'tree', or 'auto' (decided per page).  Everything that
    needs the page text is read before the Python stage, so the rows that wait
    for it carry no text beyond what goes to Python.
    """
    stripped, main, tree_page, tags, raw, json_ld = _reading_columns(html, mode == "auto")
    with_json = pages.withColumn("_json_ld", json_ld)
    if mode == "tree":
        treed = with_json.withColumn("_tree", F.when(F.col(html).isNotNull(), tree_fields(F.col(html))))
        return treed.withColumns({f"_raw_{n}": _of_tree(n) for n in _FIELDS}).drop(html, "_tree")
    read = (
        with_json.withColumn("_stripped", stripped).withColumn("_main", main)
        .withColumn("_tree_page", tree_page).withColumn("_tags", tags)
        .withColumns(raw).drop("_stripped", "_main", "_tags", html)
    )
    if mode == "sql":
        return read.drop("_tree_page")
    wanted = F.col("_tree_page")
    chosen = {f"_raw_{n}": F.when(wanted.isNotNull(), _of_tree(n)).otherwise(_raw(n)) for n in _FIELDS}
    return read.withColumn("_tree", tree_fields(wanted)).withColumns(chosen).drop("_tree_page", "_tree")


def _cleaned(text: Column) -> Column:
    """Absent stays absent; blank becomes ''."""
    return F.when(text.isNotNull(), clean_text(text))


def _schema_org(json_ld: Column, microdata: Column) -> Column:
    """Type -> objects as JSON, JSON-LD before microdata, in document order."""
    items = F.concat(
        F.coalesce(json_ld, F.array().cast("array<struct<type:string,json:string>>")),
        F.transform(
            F.coalesce(microdata, F.array().cast(RAW_TYPE["microdata"].dataType)),
            lambda m: F.struct(m["type"].alias("type"), F.to_json(m["props"]).alias("json")),
        ),
    )
    return let(
        items,
        lambda all_items: let(
            F.array_distinct(all_items["type"]),
            lambda types: F.map_from_arrays(
                types,
                F.transform(types, lambda t: F.filter(all_items, lambda i: i["type"] == t)["json"]),
            ),
        ),
    )


@built_once
def _record_columns(url: str, allowed: tuple, blocked: tuple, strict_compat: bool):
    u = F.col(url)
    empty = F.array().cast("array<string>")
    headings = F.map_from_arrays(
        F.array(*[F.lit(h) for h in H.HEADINGS]),
        F.array(*[
            F.filter(
                F.transform(F.coalesce(_raw("headings")[h], empty), lambda t: clean_text(t)), lambda t: t != ""
            )
            for h in H.HEADINGS
        ]),
    )
    canonical = F.when(F.coalesce(_raw("canonical"), F.lit("")) != "", resolve_url(u, _raw("canonical")))
    return (
        _cleaned(_raw("title")).alias("title"),
        _cleaned(_raw("content")).alias("content"),
        _cleaned(_raw("description")).alias("meta_description"),
        _cleaned(_raw("keywords")).alias("meta_keywords"),
        _raw("language").alias("language"),
        _cleaned(_raw("author")).alias("author"),
        canonical.alias("canonical_url"),
        link_targets(u, F.coalesce(_raw("hrefs"), empty), allowed, blocked).alias("links"),
        link_targets(
            u, F.coalesce(_raw("srcs"), empty), allowed, blocked, check_extension=strict_compat
        ).alias("images"),
        headings.alias("headings"),
        _schema_org(F.col("_json_ld"), _raw("microdata")).alias("schema_org_data"),
        _raw("parse_error").alias("parse_error"),
    )


def extract_pages(
    pages: DataFrame,
    mode: str = "auto",
    url: str = "url",
    html: str = "html",
    allowed: Sequence[str] = (),
    blocked: Sequence[str] = (),
    strict_compat: bool = False,
) -> DataFrame:
    """Adds the record columns to ``pages`` and drops the raw page.

    ``strict_compat`` applies the file-type rule to images as well, which
    drops ordinary image addresses.
    """
    kept = [c for c in pages.columns if c != html]
    columns = _record_columns(url, tuple(allowed), tuple(blocked), strict_compat)
    return (
        with_raw_fields(pages, html, mode)
        .select(*kept, *columns)
        .withColumn("word_count", word_count(F.col("content")))
        .select(*kept, *RECORD_COLUMNS)
    )


def heading_column(level: int) -> Column:
    return F.element_at(F.col("headings"), f"h{level}")


def explode_links(records: DataFrame, url: str = "url") -> DataFrame:
    """Relation form of the links: one row per (page, link)."""
    return exploded(records, F.col("links"), "link", F.col(url).alias("parent_url"))
