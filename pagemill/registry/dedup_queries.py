"""Queries over duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import dedup as D
from pagemill.operators.extract import extract_pages
from pagemill.registry.base import SQL_PARSED, query, sql_collapse, table
from pagemill.registry.page_queries import SQL_FEATURES, SQL_FUZZY_KEY, sql_features
from pagemill.registry.url_queries import SQL_URL_KEY_HASH
from pagemill.session import work_folder, written
from pagemill.sources import keylevels


def keyed_documents(spark, folder):
    """Documents as pages without address or title, with their keys.  Written out: read many times."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return written(D.with_keys(documents).drop("content"), "document-keys")


def keyed_pages(spark, folder):
    records = extract_pages(table(spark, folder, "pages")).withColumnRenamed("page_id", "id")
    return written(D.with_keys(records.select("id", "url", "title", "content")).drop("title", "content"), "page-keys")


def labelled_keys(spark, folder, keyed):
    """Keys of the labelled documents: the history that others are checked against."""
    labelled = table(spark, folder, "labels").select(F.col("doc_id").alias("id")).distinct()
    return D.key_rows(keyed.join(labelled, "id", "left_semi"), carry=()).distinct()


SQL_DOC_KEYS = f"""
{SQL_FEATURES},
keys AS (SELECT d.doc_id AS id, CASE WHEN d.text <> '' THEN sha256({sql_collapse('lower(d.text)')}) END AS content_key,
           CASE WHEN d.text <> '' THEN {SQL_FUZZY_KEY} END AS fuzzy_key
         FROM documents d JOIN features USING (doc_id))"""

SQL_ALL_PAGE_KEYS = f"""
{SQL_PARSED},
page_texts AS (SELECT page_id AS doc_id, content AS text, title FROM parsed),
{sql_features('page_texts')},
all_page_keys AS (SELECT page_id AS id, url, {SQL_URL_KEY_HASH} AS url_key, sha256({sql_collapse('lower(content)')}) AS content_key,
                    CASE WHEN title <> '' THEN md5({sql_collapse('lower(title)')}) END AS title_key,
                    {SQL_FUZZY_KEY} AS fuzzy_key FROM parsed JOIN features ON doc_id = page_id)"""

SQL_PAGE_KEYS = f"""
{SQL_PARSED},
page_keys AS (SELECT page_id AS id, {SQL_URL_KEY_HASH} AS url_key, sha256({sql_collapse('lower(content)')}) AS content_key,
                md5({sql_collapse('lower(title)')}) AS title_key FROM parsed)"""


@query(f"WITH {SQL_DOC_KEYS} SELECT * FROM keys")
def dedup_keys(spark, folder):
    return keyed_documents(spark, folder).select("id", "content_key", "fuzzy_key")


@query(f"WITH {SQL_PAGE_KEYS} SELECT id, url_key, content_key, title_key FROM page_keys")
def dedup_keys_pages(spark, folder):
    return keyed_pages(spark, folder).select("id", "url_key", "content_key", "title_key")


@query(f"""
WITH {SQL_DOC_KEYS}, labelled AS (SELECT * FROM keys WHERE id IN (SELECT doc_id FROM labels))
SELECT id, false AS url_duplicate, content_key IN (SELECT content_key FROM labelled) AS content_duplicate,
  false AS title_duplicate, fuzzy_key IN (SELECT fuzzy_key FROM labelled) AS fuzzy_duplicate FROM keys""")
def dedup_flags(spark, folder):
    keyed = keyed_documents(spark, folder)
    flagged = D.duplicate_flags(keyed, labelled_keys(spark, folder, keyed))
    return flagged.select("id", *[f"{t}_duplicate" for t in D.KEY_TYPES])


def sql_as_of(keys: str, **columns: str) -> str:
    """One row at a time in id order over relation ``keys``: flags against the keys that the kept rows have registered so far.

    ``columns`` gives the key column of each kind that the relation has; title never decides.
    """
    kinds = ("url", "content", "title", "fuzzy")
    named = ", ".join(f"{columns.get(k, 'NULL::VARCHAR')} AS {k}_key" for k in kinds)
    hits = ", ".join(f"coalesce(list_contains(w.{k}_set, o.{k}_key), false) AS {k}_duplicate" for k in kinds)
    sets = ", ".join(f"CASE WHEN kept AND {k}_key IS NOT NULL THEN list_append({k}_set, {k}_key) ELSE {k}_set END" for k in kinds)
    flags = [f"{k}_duplicate" for k in kinds]
    return f"""
as_of_rows AS MATERIALIZED (SELECT id, {named}, row_number() OVER (ORDER BY id) AS n FROM {keys}),
judged(n, id, kept, {", ".join(flags)}, {", ".join(f"{k}_set" for k in kinds)}) AS (
  SELECT 0::BIGINT, NULL::BIGINT, false, false, false, false, false, {", ".join("[]::VARCHAR[]" for _ in kinds)}
  UNION ALL
  SELECT n, id, kept, {", ".join(flags)}, {sets}
  FROM (SELECT *, NOT (url_duplicate OR content_duplicate OR fuzzy_duplicate) AS kept
        FROM (SELECT o.*, {", ".join(f"w.{k}_set" for k in kinds)}, {hits} FROM judged w JOIN as_of_rows o ON o.n = w.n + 1))),
flagged AS (SELECT * FROM judged WHERE id IS NOT NULL),
registered AS (SELECT {", ".join(f"len(list_distinct({k}_set)) AS total_{k}_hashes" for k in kinds)} FROM judged ORDER BY n DESC LIMIT 1)"""


def judged(keyed):
    """Rows of ``keyed`` as each was judged when it came, in the order of ids."""
    return D.as_of_flags(keyed, D.keep_greedy(keyed, "id"), "id")


@query(f"""
WITH RECURSIVE {SQL_DOC_KEYS}, {sql_as_of('keys', content='content_key', fuzzy='fuzzy_key')}
SELECT id, kept, content_duplicate, fuzzy_duplicate, content_duplicate AS strict_verdict, content_duplicate OR fuzzy_duplicate AS verdict FROM flagged""")
def dedup_verdict(spark, folder):
    """Flags against what was stored when a document came, and the verdicts from them."""
    flagged = judged(keyed_documents(spark, folder))
    return flagged.select(
        "id", "kept", "content_duplicate", "fuzzy_duplicate",
        D.is_duplicate(strict=True).alias("strict_verdict"), D.is_duplicate().alias("verdict"),
    )


@query(f"WITH {SQL_DOC_KEYS} SELECT min(id) AS id, content_key FROM keys GROUP BY content_key")
def dedup_keep_first(spark, folder):
    documents = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), D.content_hash(F.col("text")).alias("content_key")
    )
    return D.keep_first(documents, "content_key", "id").select("id", "content_key")


SQL_PAGE_STATS = f"""
{SQL_ALL_PAGE_KEYS}, {sql_as_of('all_page_keys', url='url_key', content='content_key', title='title_key', fuzzy='fuzzy_key')},
dedup_stats AS (
  SELECT count(*) AS total_checks, count(*) FILTER (url_duplicate) AS url_duplicates, count(*) FILTER (content_duplicate) AS content_duplicates,
    count(*) FILTER (title_duplicate) AS title_duplicates, count(*) FILTER (fuzzy_duplicate) AS fuzzy_duplicates,
    any_value(total_url_hashes) AS total_url_hashes, any_value(total_content_hashes) AS total_content_hashes,
    any_value(total_title_hashes) AS total_title_hashes, any_value(total_fuzzy_hashes) AS total_fuzzy_hashes FROM flagged, registered)"""


@query(f"WITH RECURSIVE {SQL_PAGE_STATS} SELECT * FROM dedup_stats")
def dedup_stats(spark, folder):
    """All four kinds, counted over checks against stored pages."""
    return D.duplicate_stats(judged(keyed_pages(spark, folder)))


@query(f"""
WITH {SQL_ALL_PAGE_KEYS}, known AS (SELECT * FROM all_page_keys WHERE id % 3 = 0 AND url LIKE 'https:%')
SELECT id, url_key IN (SELECT url_key FROM known) AS url_duplicate, content_key IN (SELECT content_key FROM known) AS content_duplicate,
  title_key IN (SELECT title_key FROM known) AS title_duplicate, fuzzy_key IN (SELECT fuzzy_key FROM known) AS fuzzy_duplicate FROM all_page_keys""")
def dedup_flags_pages(spark, folder):
    """All four flags of the pages against the keys of some of them, which are stored in levels."""
    keyed, path = keyed_pages(spark, folder), work_folder(spark, "history")
    known = keyed.filter((F.col("id") % 3 == 0) & F.startswith("url", F.lit("https:")))
    for batch in range(3):
        part = D.key_rows(known.filter(F.floor(F.col("id") / 3) % 3 == batch), carry=()).distinct()
        keylevels.append_keys(spark, path, part, F.lit("2024-01-01").cast("timestamp"), "known", batch)
    keylevels.settle(spark, path, "known", 3, fan_in=2)
    seen = keylevels.stored_among(spark, path, D.key_rows(keyed, carry=()).distinct())
    return D.duplicate_flags(keyed, seen).select("id", *[f"{t}_duplicate" for t in D.KEY_TYPES])


def sql_greedy(keys: str, columns: str) -> str:
    """One pass in id order over relation ``keys``; ``taken`` holds the keys of the kept rows so far."""
    return f"""
ordered AS MATERIALIZED (SELECT id, list_filter([{columns}], lambda k: k IS NOT NULL) AS ks, row_number() OVER (ORDER BY id) AS n FROM {keys}),
walk(n, id, kept, taken) AS (
  SELECT 0::BIGINT, NULL::BIGINT, false, []::VARCHAR[]
  UNION ALL
  SELECT o.n, o.id, NOT list_has_any(w.taken, o.ks), CASE WHEN list_has_any(w.taken, o.ks) THEN w.taken ELSE list_concat(w.taken, o.ks) END
  FROM walk w JOIN ordered o ON o.n = w.n + 1)"""


@query(f"WITH RECURSIVE {SQL_DOC_KEYS}, {sql_greedy('keys', 'content_key, fuzzy_key')} SELECT id, kept FROM walk WHERE id IS NOT NULL")
def dedup_greedy(spark, folder):
    """Greedy keep-first by content and near-duplicate key, in document order."""
    return D.greedy_dedup(keyed_documents(spark, folder), "id").select("id", "kept")


@query(f"""
WITH {SQL_DOC_KEYS}, labelled AS (SELECT * FROM keys WHERE id IN (SELECT doc_id FROM labels))
SELECT min(id) AS id, content_key FROM keys
WHERE content_key NOT IN (SELECT content_key FROM labelled) GROUP BY content_key""")
def dedup_new_contents(spark, folder):
    """Greedy keep-first by the strict keys, after dropping what the history holds."""
    keyed = keyed_documents(spark, folder)
    seen = labelled_keys(spark, folder, keyed)
    return D.greedy_dedup(keyed, "id", D.STRICT, seen=seen).filter("kept").select("id", "content_key")


@query(f"""
WITH {SQL_DOC_KEYS}, labelled AS (SELECT * FROM keys WHERE id IN (SELECT doc_id FROM labels))
SELECT 'content' AS key_type, content_key AS key FROM (SELECT content_key FROM keys EXCEPT SELECT content_key FROM labelled)
UNION ALL
SELECT 'fuzzy', fuzzy_key FROM (SELECT fuzzy_key FROM keys EXCEPT SELECT fuzzy_key FROM labelled)""")
def seen_keys_added(spark, folder):
    keyed = keyed_documents(spark, folder)
    added = D.new_keys(keyed, labelled_keys(spark, folder, keyed), F.lit("2024-01-01").cast("timestamp"))
    return added.select("key_type", "key")


@query("""
SELECT props AS key, min(ts) AS first_seen FROM events GROUP BY props
HAVING min(ts) >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 30 DAY + INTERVAL 1 DAY""")
def hash_retention(spark, folder):
    seen = table(spark, folder, "events").groupBy(F.col("props").alias("key")).agg(F.min("ts").alias("first_seen"))
    return D.retained_keys(seen, F.lit("2024-01-31").cast("timestamp_ntz"))
