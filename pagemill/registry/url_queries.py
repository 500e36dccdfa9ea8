"""Queries over page addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.functions.values import SKIP_EXTENSIONS, TRACKING_PARAMS
from pagemill.operators.domains import filter_domains, matching_domains
from pagemill.registry.base import SQL_URL_PARTS, query, table


@query(f"WITH {SQL_URL_PARTS} SELECT page_id, domain FROM parts")
def url_domain(spark, folder):
    return table(spark, folder, "pages").select("page_id", U.url_domain(F.col("url")).alias("domain"))


@query(f"WITH {SQL_URL_PARTS} SELECT page_id, scheme || '://' || domain AS origin FROM parts")
def url_origin(spark, folder):
    return table(spark, folder, "pages").select("page_id", U.url_origin(F.col("url")).alias("origin"))


_REFERENCES = ("?q=1", "../up/x y?a#f", "//Other.example.org/z", "/root/./a/../b", "mailto:a@b.org", "#top", "next.html")


@query(rf"""
WITH {SQL_URL_PARTS},
bases AS (SELECT *, scheme || '://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS origin,
                 regexp_replace(path, '[^/]*$', '') AS folder FROM parts),
hrefs AS (SELECT unnest(['?q=1', '../up/x y?a#f', '//Other.example.org/z', '/root/./a/../b', 'mailto:a@b.org', '#top', 'next.html']) AS href)
SELECT page_id, href, CASE href
    WHEN '?q=1' THEN origin || path || '?q=1'
    WHEN '../up/x y?a#f' THEN origin || regexp_replace(folder, '[^/]+/$', '') || 'up/x y?a#f'
    WHEN '//Other.example.org/z' THEN scheme || '://Other.example.org/z'
    WHEN '/root/./a/../b' THEN origin || '/root/b'
    WHEN 'mailto:a@b.org' THEN href
    WHEN '#top' THEN origin || path || CASE WHEN query = '' THEN '' ELSE '?' || query END || '#top'
    ELSE origin || folder || 'next.html' END AS resolved
FROM bases, hrefs""")
def url_resolve(spark, folder):
    hrefs = F.explode(F.array(*[F.lit(h) for h in _REFERENCES]))
    return table(spark, folder, "pages").select("page_id", "url", hrefs.alias("href")).select(
        "page_id", "href", U.resolve_url(F.col("url"), F.col("href")).alias("resolved")
    )


@query(r"""
SELECT page_id,
  lower(regexp_extract(url, '^[^/]*//[^/?#]*', 0)) || regexp_replace(regexp_replace(url, '^[^/]*//[^/?#]*', ''), '#.*$', '') AS normalized
FROM pages""")
def url_normalize(spark, folder):
    shouted = F.concat(
        F.upper(F.regexp_extract("url", "^[^/]*//[^/?#]*", 0)), F.regexp_replace("url", "^[^/]*//[^/?#]*", "")
    )
    return table(spark, folder, "pages").select("page_id", U.normalize_url(shouted).alias("normalized"))


_MESSY_QUERY = "utm_medium=a&B=2&A=%41+b~*&c=&fbclid=1&A=z"
_tracking = ", ".join(f"'{p}'" for p in TRACKING_PARAMS)


@query(rf"""
WITH {SQL_URL_PARTS},
given AS (
  SELECT *, lower(CASE WHEN query = '' THEN '' ELSE query || '&' END || '{_MESSY_QUERY}') AS q,
    regexp_replace(lower(path), '(.)/$', '\1') AS p FROM parts
),
pairs AS (
  SELECT page_id, unnest(string_split(q, '&')) AS part, generate_subscripts(string_split(q, '&'), 1) AS i FROM given
),
decoded AS (
  SELECT page_id, i, url_decode(replace(string_split(part, '=')[1], '+', ' ')) AS k,
         url_decode(replace(string_split(part, '=')[2], '+', ' ')) AS v FROM pairs
),
queries AS (
  SELECT page_id, string_agg(
    replace(url_encode(k), '%20', '+') || '=' || replace(url_encode(v), '%20', '+'), '&' ORDER BY k, i) AS cq
  FROM decoded WHERE v <> '' AND k NOT IN ({_tracking}) GROUP BY page_id
)
SELECT page_id, scheme || '://' || domain || p || CASE WHEN cq IS NULL THEN '' ELSE '?' || cq END AS url_key
FROM given LEFT JOIN queries USING (page_id)""")
def url_canonical_key(spark, folder):
    bare = F.substring_index("url", "#", 1)
    messy = F.concat(bare, F.when(F.contains(bare, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit(_MESSY_QUERY + "#Frag"))
    return table(spark, folder, "pages").select("page_id", U.canonical_url_key(messy).alias("url_key"))


_extensions = "|".join(SKIP_EXTENSIONS)


@query(rf"""
WITH {SQL_URL_PARTS}
SELECT page_id,
  NOT contains(domain, 'spam') AND (contains(domain, 'example.com') OR contains(domain, 'example.org')) AS valid,
  NOT (domain = 'spam-farm.example.org' OR suffix(domain, '.spam-farm.example.org')) AND (suffix(domain, '.example.com') OR suffix(domain, '.example.org')) AS valid_suffix,
  NOT regexp_matches(path, '\.({_extensions})$') AS page_type,
  false AS archive_valid
FROM parts""")
def url_valid(spark, folder):
    url = F.col("url")
    archive = F.concat(F.substring_index(F.substring_index(url, "#", 1), "?", 1), F.lit("-dump.TAR?v=1"))
    return table(spark, folder, "pages").select(
        "page_id",
        U.is_valid_url(url, ("example.com", "example.org"), ("spam",)).alias("valid"),
        U.is_valid_url(url, ("example.com", "example.org"), ("spam-farm.example.org",), match="suffix").alias("valid_suffix"),
        U.is_valid_url(url).alias("page_type"),
        U.is_valid_url(archive).alias("archive_valid"),
    )


SQL_URL_KEY_HASH = r"""sha256(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''),
    '([?&])(ref|utm_source)=[^&]*', '\1', 'g'), '[?&]+$', ''), '([^/])/$', '\1')))"""


@query(f"SELECT page_id, sha256(url) AS storage_hash, {SQL_URL_KEY_HASH} AS url_key_hash FROM pages")
def url_hash(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", U.storage_hash(url).alias("storage_hash"), U.url_key_hash(url).alias("url_key_hash")
    )


_SQL_LISTS = f"""
{SQL_URL_PARTS},
entries AS (SELECT DISTINCT string_split(domain, '.')[1] AS entry FROM parts
            WHERE scheme = 'http' AND length(string_split(domain, '.')[1]) > 3)"""


def _domain_lists(spark, folder):
    """Pages with their domain, and a list made of the first labels of plain-http hosts."""
    pages = table(spark, folder, "pages").select(
        "page_id", "url", U.url_domain(F.col("url")).alias("domain")
    )
    first = F.substring_index("domain", ".", 1)
    entries = pages.filter(F.startswith("url", F.lit("http://")) & (F.length(first) > 3)).select(first.alias("entry"))
    return pages, entries


@query(f"""WITH {_SQL_LISTS}
SELECT page_id, domain FROM parts
WHERE NOT EXISTS (SELECT 1 FROM entries WHERE contains(parts.domain, entries.entry))""")
def domain_blocklist(spark, folder):
    pages, entries = _domain_lists(spark, folder)
    return filter_domains(pages, blocked=entries).select("page_id", "domain")


@query(f"""WITH {_SQL_LISTS}
SELECT DISTINCT domain FROM parts, (SELECT entry || '.' || unnest(['example.com', 'example.org', 'example.net']) AS entry FROM entries) e
WHERE domain = entry OR suffix(domain, '.' || entry)""")
def domain_allowlist_suffix(spark, folder):
    pages, entries = _domain_lists(spark, folder)
    hosts = F.explode(F.array(*[F.lit(f"example.{t}") for t in ("com", "org", "net")]))
    full = entries.select("entry", hosts.alias("h")).select(F.concat("entry", F.lit("."), "h").alias("entry"))
    return matching_domains(pages, full, match="suffix")
