"""Queries over page contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions import text as T
from pagemill.functions.urls import url_domain
from pagemill.operators.extract import explode_links, extract_pages, heading_column
from pagemill.operators.graph import outbound_links
from pagemill.operators.skew import exploded
from pagemill.plans.flagship import domain_summary
from pagemill.registry.base import SQL_PARSED, query, sql_clean, sql_collapse, sql_decode, sql_words, table


@query(f"""
WITH {SQL_PARSED},
recs AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain, title, content, links, url,
    {sql_words('content')} AS words,
    row_number() OVER (PARTITION BY lower({sql_collapse('content')}) ORDER BY page_id) AS rn FROM parsed)
SELECT domain, count(*) AS pages, CAST(sum(words) AS BIGINT) AS words, CAST(sum(len(links)) AS BIGINT) AS links
FROM recs WHERE rn = 1 GROUP BY domain""")
def domain_page_summary(spark, folder):
    return domain_summary(table(spark, folder, "pages"))


def _records(spark, folder, mode="auto"):
    return extract_pages(table(spark, folder, "pages"), mode)


@query(f"""
WITH {SQL_PARSED}, plain AS (SELECT page_id, html, s FROM stripped)
SELECT page_id, length(regexp_replace(html, '{'(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>'}', '', 'g')) AS chars_left,
  contains(s, 'track(') AS has_script, contains(s, '<!--') AS has_comment FROM plain""")
def page_boilerplate(spark, folder):
    stripped = H.strip_boilerplate(F.col("html"))
    return table(spark, folder, "pages").select("page_id", stripped.alias("s")).select(
        "page_id",
        F.length(F.replace("s", F.lit("<!>"), F.lit(""))).cast("bigint").alias("chars_left"),
        F.contains("s", F.lit("track(")).alias("has_script"),
        F.contains("s", F.lit("<!--")).alias("has_comment"),
    )


@query(f"WITH {SQL_PARSED} SELECT page_id, title FROM parsed")
def page_title(spark, folder):
    return _records(spark, folder).select("page_id", "title")


@query(f"WITH {SQL_PARSED} SELECT page_id, language FROM parsed")
def page_lang(spark, folder):
    return _records(spark, folder).select("page_id", "language")


SQL_H1 = sql_clean(sql_decode("regexp_replace(regexp_extract(s, '(?is)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))


@query(f"WITH {SQL_PARSED} SELECT page_id, {SQL_H1} AS h1 FROM stripped")
def page_h1(spark, folder):
    return _records(spark, folder).select("page_id", F.array_join(heading_column(1), "|").alias("h1"))


@query(f"WITH {SQL_PARSED} SELECT page_id, content FROM parsed")
def page_content(spark, folder):
    return _records(spark, folder).select("page_id", "content")


@query(f"WITH {SQL_PARSED} SELECT page_id, content, title, array_to_string(links, ' ') AS links FROM parsed")
def page_content_tree(spark, folder):
    """The same pages through the element tree."""
    return _records(spark, folder, "tree").select(
        "page_id", "content", "title", F.array_join("links", " ").alias("links")
    )


@query(f"WITH {SQL_PARSED} SELECT page_id, CAST({sql_words('content')} AS INTEGER) AS word_count FROM parsed")
def page_word_count(spark, folder):
    return _records(spark, folder).select("page_id", "word_count")


@query(f"WITH {SQL_PARSED} SELECT page_id, unnest(links) AS link FROM parsed")
def page_links(spark, folder):
    return exploded(_records(spark, folder), F.col("links"), "link", "page_id")


@query(f"""WITH {SQL_PARSED}
SELECT page_id, unnest(list_filter(links, lambda l: NOT contains(l, 'spam'))) AS link FROM parsed""")
def outbound_links_allowed(spark, folder):
    return exploded(outbound_links(_records(spark, folder), blocked=("spam",)), F.col("links"), "link", "page_id")


# --- odd mark-up, made from the given pages --------------------------------

def odd_pages(spark, folder):
    """Every page with attributes in misleading order, nested and open headings, and a commented-out JSON-LD block.

    Where the page id is odd, an empty main element comes first.
    """
    key = F.col("page_id").cast("string")
    odd = F.concat(
        F.lit('<a title="see href=/wrong now" data-href=\'/no\' href="/right/'), key, F.lit('">x</a><a HREF=/q/'), key, F.lit(" href=/second>y</a>"),
        F.lit("<h2>A"), key, F.lit(" <h3>B</h3></h2><h4>open"), key, F.lit("</article>"),
    )
    head = F.concat(
        F.lit('<!-- <script type="application/ld+json">{"@type":"No"}</script> --><script type="application/ld+json">{"@type":"Yes","c":"<!-- '), key,
        F.lit(' -->"}</script></head>'),
    )
    main = F.when(F.col("page_id") % 2 == 1, F.lit("<main></main><article")).otherwise(F.lit("<article"))
    html = F.replace(F.replace(F.replace("html", F.lit("</article>"), odd), F.lit("</head>"), head), F.lit("<article"), main)
    return table(spark, folder, "pages").withColumn("html", html)


@query(f"""
WITH {SQL_PARSED}, origins AS (SELECT *, regexp_extract(url, '^https?://[^/?#]*', 0) AS origin FROM parsed)
SELECT page_id, unnest(list_sort(list_distinct(list_concat(links, [origin || '/right/' || page_id, origin || '/q/' || page_id])))) AS link FROM origins""")
def page_links_odd(spark, folder):
    return exploded(extract_pages(odd_pages(spark, folder)), F.col("links"), "link", "page_id")


@query(f"""
WITH {SQL_PARSED}
SELECT page_id, 'A' || page_id || ' B' AS h2, 'B' AS h3, page_id % 2 = 1 AS empty_main, '{{"@type":"Yes","c":"<!-- ' || page_id || ' -->"}}' AS objects FROM parsed""")
def page_elements_odd(spark, folder):
    """Nested headings, an empty main element before an article, and objects in comments."""
    records = extract_pages(odd_pages(spark, folder))
    objects = F.array_join(F.flatten(F.map_values("schema_org_data")), " ")
    return records.select(
        "page_id", F.array_join(heading_column(2), "|").alias("h2"), F.array_join(heading_column(3), "|").alias("h3"),
        (F.col("content") == "").alias("empty_main"), objects.alias("objects"),
    )


# --- pages with more markup, made from the given pages ---------------------

def rich_pages(spark, folder):
    """Every page with head metadata, headings, images, JSON-LD and a changed main element."""
    lang, key = F.regexp_extract("html", '<html lang="([^"]*)"', 1), F.col("page_id").cast("string")
    head = F.concat(
        F.lit('<meta name="description" content="About  page '), key, F.lit(" in "), lang, F.lit('">'),
        F.lit('<meta property="og:description" content="other"><meta name=\'keywords\' content="'), lang,
        F.lit(', crawl"><meta property="article:author" content="Author '), key,
        F.lit(' &amp; co"><link rel="canonical" href="../canonical/'), key, F.lit('?v=1#x">'),
        F.lit('<script type="application/ld+json">{"@type":"Article","headline":"p'), key,
        F.lit('","lang":"'), lang, F.lit('"}</script><script type="application/ld+json">[{"@type":["Person","Agent"],"id":'),
        key, F.lit('},{"name":"x"},7]</script><script type="application/ld+json">{bad json</script></head>'),
    )
    body = F.concat(
        F.lit('<h2>Part  '), key, F.lit('</h2><h2> </h2><h3>a<b>b</b></h3><img src="/img/'), key,
        F.lit('.png"><img alt="y" src="https://CDN.example.org/'), key, F.lit('#x"><img src=""></article>'),
    )
    return table(spark, folder, "pages").withColumn(
        "html", F.replace(F.replace("html", F.lit("</head>"), head), F.lit("</article>"), body)
    )


_SQL_LANG = "regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)"


@query(f"""
SELECT page_id, 'About page ' || page_id || ' in ' || {_SQL_LANG} AS meta_description,
  {_SQL_LANG} || ', crawl' AS meta_keywords, 'Author ' || page_id || ' & co' AS author FROM pages""")
def page_meta(spark, folder):
    return extract_pages(rich_pages(spark, folder)).select("page_id", "meta_description", "meta_keywords", "author")


@query(r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*', 0) ||
  regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '[^/]*$', ''), '[^/]+/$', '')
  || 'canonical/' || page_id || '?v=1#x' AS canonical_url FROM pages""")
def page_canonical(spark, folder):
    return extract_pages(rich_pages(spark, folder)).select("page_id", "canonical_url")


@query(f"""
WITH {SQL_PARSED}
SELECT page_id, {SQL_H1} AS h1, 'Part ' || page_id AS h2, 'ab' AS h3, 'Part ' || page_id || ' ab' AS tail FROM stripped""")
def page_headings(spark, folder):
    joined = [F.array_join(heading_column(level), "|").alias(f"h{level}") for level in (1, 2, 3)]
    tail = F.concat_ws(" ", F.element_at(heading_column(2), -1), F.element_at(heading_column(3), -1))
    return extract_pages(rich_pages(spark, folder)).select("page_id", *joined, tail.alias("tail"))


@query(r"""
SELECT page_id, unnest(['https://cdn.example.org/' || page_id, regexp_extract(url, '^[a-z]+://[^/]*', 0) || '/img/' || page_id || '.png']) AS image,
  1 AS strict_images FROM pages""")
def page_images(spark, folder):
    pages = rich_pages(spark, folder)
    loose = exploded(extract_pages(pages), F.col("images"), "image", "page_id")
    strict = extract_pages(pages, strict_compat=True).select("page_id", F.size("images").alias("strict_images"))
    return loose.join(strict, "page_id")


@query(f"""
SELECT page_id, unnest(['Article', 'Person', 'Unknown']) AS type,
  unnest(['{{"@type":"Article","headline":"p' || page_id || '","lang":"' || {_SQL_LANG} || '"}}',
          '{{"@type":["Person","Agent"],"id":' || page_id || '}}', '{{"name":"x"}}']) AS object FROM pages""")
def json_ld(spark, folder):
    records = extract_pages(rich_pages(spark, folder))
    by_type = exploded(records, F.map_entries("schema_org_data"), "e", "page_id")
    return exploded(by_type, F.col("e.value"), "object", "page_id", F.col("e.key").alias("type"))


def microdata_pages(spark, folder):
    """Every page with a product described in microdata, some of it inside navigation."""
    key = F.col("page_id").cast("string")
    item = F.concat(
        F.lit('<nav itemscope itemtype="https://schema.org/Gone"><i itemprop="x">y</i><a href="/inner">inner</a></nav>'
              '<div itemscope itemtype="https://schema.org/Product"><span itemprop="sku"> S'), key,
        F.lit(' </span><meta itemprop="price" content="9.5"><b itemprop="empty"></b><i itemprop="sku">T'), key,
        F.lit('</i></div></article>'),
    )
    return table(spark, folder, "pages").withColumn("html", F.replace("html", F.lit("</article>"), item))


@query(f"""
WITH {SQL_PARSED}
SELECT page_id, 'Product' AS type, 'T' || page_id AS sku, '9.5' AS price, len(links) AS n_links FROM parsed""")
def microdata(spark, folder):
    records = extract_pages(microdata_pages(spark, folder))
    n_links = F.size("links").cast("bigint").alias("n_links")
    by_type = exploded(records, F.map_entries("schema_org_data"), "e", "page_id", n_links)
    return exploded(by_type, F.col("e.value"), "o", "page_id", "n_links", F.col("e.key").alias("type")).select(
        "page_id", "type", F.get_json_object("o", "$.sku").alias("sku"), F.get_json_object("o", "$.price").alias("price"), "n_links"
    )


@query(f"WITH {SQL_PARSED} SELECT page_id, content || ' after' AS content, array_to_string(links, ' ') AS links FROM parsed")
def page_content_by_class(spark, folder):
    """Main content found by class, with nested elements and navigation inside it."""
    html = F.replace(
        F.replace("html", F.lit("<article>"), F.lit('<div class="wide content"><div class="menu"><a href="/inner">in</a></div>')),
        F.lit("</article>"), F.lit("<div>after</div><aside>beside</aside></div>"),
    )
    records = extract_pages(table(spark, folder, "pages").withColumn("html", html))
    return records.select("page_id", "content", F.array_join("links", " ").alias("links"))


@query(f"""
WITH {SQL_PARSED}
SELECT page_id, CAST(NULL AS VARCHAR) AS parse_error,
  {sql_clean(sql_decode("regexp_replace(regexp_replace(regexp_replace(split_part(s, '<body>', 2), '(?is)<nav>.*?</nav>', ' ', 'g'), '(?is)<footer>.*?</footer>', ' ', 'g'), '<[^>]*>', ' ', 'g')"))} AS content,
  0 AS n_links
FROM stripped""")
def page_content_body(spark, folder):
    """Without any main element the body counts, and navigation links are lost."""
    html = F.replace(F.replace("html", F.lit("<article>"), F.lit("<section>")), F.lit("</article>"), F.lit("</section>"))
    records = extract_pages(table(spark, folder, "pages").withColumn("html", html))
    return records.select("page_id", "parse_error", "content", F.size("links").alias("n_links"))


@query(f"""
WITH {SQL_PARSED}
SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain, count(*) AS links, count(DISTINCT link) AS targets
FROM (SELECT url, unnest(links) AS link FROM parsed) GROUP BY 1""")
def links_by_domain(spark, folder):
    edges = explode_links(_records(spark, folder))
    return edges.groupBy(url_domain(F.col("parent_url")).alias("domain")).agg(
        F.count(F.lit(1)).alias("links"), F.count_distinct("link").alias("targets")
    )


# --- text ------------------------------------------------------------------


@query(f"SELECT doc_id, {sql_clean('text')} AS cleaned FROM documents")
def clean_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query("""SELECT doc_id, sha256(k) AS content_hash FROM (SELECT doc_id, %s AS k FROM documents)""" % sql_collapse("lower(text)"))
def content_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query(f"WITH {SQL_PARSED} SELECT page_id, md5({sql_collapse('lower(title)')}) AS title_hash FROM parsed")
def title_hash(spark, folder):
    return _records(spark, folder).select("page_id", T.title_hash(F.col("title")).alias("title_hash"))


_stop = ", ".join(f"'{w}'" for w in T.STOP_WORDS)

def sql_features(source: str) -> str:
    """CTE ``features`` for a relation ``(doc_id, text, title)``."""
    return f"""
words AS (SELECT doc_id, unnest(string_split(k, ' ')) AS w, generate_subscripts(string_split(k, ' '), 1) AS p
          FROM (SELECT doc_id, {sql_collapse('lower(text)')} AS k FROM {source})),
significant AS (SELECT doc_id, w, count(*) AS n, min(p) AS p FROM words
                WHERE length(w) > 3 AND w NOT IN ({_stop}) GROUP BY doc_id, w),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rn FROM significant),
tops AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS significant_words,
                string_agg(w, ' ' ORDER BY rn) FILTER (rn <= 10) AS top_words FROM ranked GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_words FROM words WHERE w <> '' GROUP BY doc_id),
features AS (
  SELECT d.doc_id, coalesce(n_words, 0) // 100 AS word_count_bucket, length(text) // 1000 AS char_count_bucket,
         CASE WHEN title = '' THEN 0 ELSE len(string_split(title, ' ')) END AS title_words,
         coalesce(significant_words, 0) AS significant_words, coalesce(top_words, '') AS top_words
  FROM {source} d LEFT JOIN counts USING (doc_id) LEFT JOIN tops USING (doc_id)
)"""


SQL_FEATURES = "untitled AS (SELECT doc_id, text, '' AS title FROM documents)," + sql_features("untitled")
SQL_FUZZY_KEY = "md5(concat_ws(' ', word_count_bucket, char_count_bucket, title_words, significant_words, top_words))"


@query(f"WITH {SQL_FEATURES} SELECT * FROM features")
def fuzzy_features(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", T.fuzzy_features(F.col("text"), F.lit("")).alias("f")
    ).select("doc_id", "f.*").withColumn("top_words", F.array_join("top_words", " "))


@query(f"WITH {SQL_FEATURES} SELECT doc_id, {SQL_FUZZY_KEY} AS fuzzy_hash FROM features")
def fuzzy_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.fuzzy_hash(F.col("text"), F.lit("")).alias("fuzzy_hash"))


@query(r"""
SELECT doc_id, CASE lang
    WHEN 'fr' THEN octet_length(encode(text))
    WHEN 'de' THEN NULL
    WHEN 'es' THEN CASE WHEN regexp_matches(hex(encode(text)), '^(..)*(81|8D|8F|90|9D)') THEN length(text) ELSE octet_length(encode(text)) END
    ELSE length(text) END AS chars
FROM documents""")
def decode_bodies(spark, folder):
    """Texts as UTF-8 bytes with a declared charset per language: right, wrong, unknown or missing."""
    charset = (
        F.when(F.col("lang") == "en", "UTF-8").when(F.col("lang") == "fr", "iso-8859-1")
        .when(F.col("lang") == "de", "no-such-charset").when(F.col("lang") == "es", "windows-1252")
    )
    return table(spark, folder, "documents").select(
        "doc_id", F.length(T.decode_body(F.encode("text", "UTF-8"), charset)).cast("bigint").alias("chars")
    )
