"""Registration of queries with their DuckDB counterparts, and shared SQL pieces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pagemill.functions.values import EMAIL_MASK, EMAIL_PATTERN, WS
from pagemill.sources.tables import spread

QueryFunction = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFunction
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function under its name; ``sql`` is the equivalent for DuckDB."""

    def register(function: QueryFunction) -> QueryFunction:
        QUERIES[function.__name__] = Query(function, sql)
        return function

    return register


# Tables whose rows are costly to process.
_HEAVY = {"pages": "page_id", "documents": "doc_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(scan, _HEAVY[name]) if name in _HEAVY else scan


# --- SQL pieces (DuckDB) ---------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {quoted(WS + '+')}, ' ', 'g'))"


def sql_clean(x: str) -> str:
    return f"regexp_replace({sql_collapse(x)}, {quoted(EMAIL_PATTERN)}, {quoted(EMAIL_MASK)}, 'g')"


def sql_key(x: str) -> str:
    return sql_collapse(f"lower({x})")


def sql_words(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END"


def sql_decode(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\xa0"), ("&copy;", "\xa9"),
                         ("&middot;", "\xb7"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


STRIP = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>"

# CTE ``parsed``: what plain regular expressions read from the pages.
SQL_PARSED = f"""
stripped AS (SELECT page_id, url, html, regexp_replace(html, '{STRIP}', ' ', 'g') AS s FROM pages),
parsed AS (
  SELECT page_id, url,
    {sql_clean(sql_decode("regexp_extract(s, '(?is)<title>(.*?)</title>', 1)"))} AS title,
    regexp_extract(s, '<html lang="([^"]*)"', 1) AS language,
    {sql_clean(sql_decode("regexp_replace(regexp_extract(s, '(?is)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g')"))} AS content,
    list_sort(list_distinct(list_transform(
      regexp_extract_all(s, '<a href="(/[^"]*)"', 1),
      lambda h: regexp_extract(url, '^https?://[^/?#]*', 0) || h))) AS links
  FROM stripped
)"""

SQL_URL_PARTS = r"""
parts AS (
  SELECT page_id, url,
    regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
    lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS domain,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '\?([^#]*)', 1) AS query
  FROM pages
)"""
