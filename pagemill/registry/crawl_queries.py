"""Queries over robots rules, the frontier and the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions.urls import url_domain, url_origin
from pagemill.operators import fetchlog, frontier, graph, robots
from pagemill.operators.extract import extract_pages
from pagemill.plans.crawl import crawl_replay as replay
from pagemill.plans.crawl import page_facts, replay_summary
from pagemill.registry.base import SQL_PARSED, SQL_URL_PARTS, query, table
from pagemill.registry.dedup_queries import SQL_ALL_PAGE_KEYS
from pagemill.schemas import FRONTIER
from pagemill.session import placed_by, work_folder, written
from pagemill.streaming.ingest import as_instant, load_frontier, log_frontier, recrawl_due, save_frontier, snapshot_frontier, without_zone

# --- fetch records, made from the events -----------------------------------

def fetch_log(spark, folder):
    """Each event as a fetch: the type gives header and outcome, the value the time it took."""
    kind, value = F.col("event_type"), F.col("value")
    error = (
        F.when(kind != "error", F.lit(None).cast("string"))
        .when(value < 10, F.lit("Blocked by robots.txt")).when(value < 30, F.lit("Request timeout"))
        .when(value < 50, F.lit("Client error: connection reset")).otherwise(F.lit("Unexpected error: closed"))
    )
    content_type = F.when(kind == "purchase", F.lit("image/png")).when(kind == "view", F.lit("Application/JSON")).when(
        kind != "error", F.lit("text/html; charset=UTF-8")
    )
    return table(spark, folder, "events").select(
        "event_id",
        F.concat(F.lit("https://host"), F.col("user_id"), F.lit(".example.org/p/"), F.col("event_id")).alias("url"),
        "ts",
        F.when(kind == "error", 0).when(kind == "view", 404).otherwise(200).alias("status_code"),
        content_type.alias("content_type"),
        F.lit("UTF-8").alias("charset"),
        F.encode(F.when(kind == "signup", F.lit("")).otherwise(F.col("props")), "UTF-8").alias("body"),
        error.alias("error"),
        value.alias("fetch_time"),
        F.least(F.floor(value / 10), F.lit(3)).cast("int").alias("retry_count"),
    )


SQL_OUTCOMES = """
outcomes AS (
  SELECT event_id, user_id, ts, value, props, event_type,
    CASE event_type WHEN 'purchase' THEN 'non_text' WHEN 'signup' THEN 'empty'
      WHEN 'error' THEN CASE WHEN value < 10 THEN 'robots_blocked' WHEN value < 30 THEN 'timeout'
                             WHEN value < 50 THEN 'client_error' ELSE 'unexpected_error' END
      ELSE 'ok' END AS outcome
  FROM events
)"""


@query("""SELECT event_id, event_type IN ('click', 'signup', 'view') AS is_text FROM events""")
def text_content_types(spark, folder):
    return fetch_log(spark, folder).select("event_id", fetchlog.is_text_content(F.col("content_type")).alias("is_text"))


@query("""SELECT doc_id, octet_length(encode(text)) <= 4096 AS accepted,
  octet_length(encode(text)) <= 4096 AND n_chars <= 2048 AS accepted_by_header FROM documents""")
def body_size_limit(spark, folder):
    body = F.encode("text", "UTF-8")
    return table(spark, folder, "documents").select(
        "doc_id",
        fetchlog.within_size_limit(body, limit=4096).alias("accepted"),
        fetchlog.within_size_limit(body, F.col("n_chars") * 2, limit=4096).alias("accepted_by_header"),
    )


@query(f"WITH {SQL_OUTCOMES} SELECT event_id, outcome FROM outcomes")
def fetch_outcomes(spark, folder):
    return fetchlog.with_outcome(fetchlog.read_bodies(fetch_log(spark, folder))).select("event_id", "outcome")


@query(f"WITH {SQL_OUTCOMES} SELECT event_id, props AS content FROM outcomes WHERE outcome = 'ok'")
def fetch_success(spark, folder):
    return fetchlog.read_bodies(fetch_log(spark, folder)).filter(fetchlog.is_success()).select("event_id", "content")


SQL_FETCH_COUNTERS = f"""
{SQL_OUTCOMES},
fetch_counters AS (SELECT count(*) FILTER (outcome <> 'robots_blocked') AS total_requests, count(*) FILTER (outcome = 'ok') AS successful_requests,
  count(*) FILTER (outcome IN ('timeout', 'client_error', 'unexpected_error')) AS failed_requests,
  count(*) FILTER (outcome = 'robots_blocked') AS robots_blocked,
  CAST(sum(octet_length(encode(props))) FILTER (outcome = 'ok') AS BIGINT) AS total_bytes,
  CAST(sum(length(props)) FILTER (outcome = 'ok') AS BIGINT) AS total_chars FROM outcomes)"""


@query(f"WITH {SQL_FETCH_COUNTERS} SELECT * FROM fetch_counters")
def fetch_counters(spark, folder):
    return fetchlog.fetch_counters(fetchlog.read_bodies(fetch_log(spark, folder)))


@query(f"""
WITH {SQL_OUTCOMES},
tries AS (SELECT *, CAST(least(floor(value / 10), 3) AS INTEGER) AS rc, outcome <> 'ok' AND floor(value / 10) < 3 AS again FROM outcomes)
SELECT event_id, CASE WHEN again THEN 'queued' ELSE 'processed' END AS state,
  CAST(CASE WHEN again THEN rc + 1 ELSE rc END AS INTEGER) AS retry_count, CASE WHEN again THEN 1 ELSE 2 END AS priority FROM tries""")
def retry_transition(spark, folder):
    attempts = fetchlog.read_bodies(fetch_log(spark, folder)).withColumn("priority", F.lit(2))
    return frontier.retry_transition(attempts, fetchlog.is_success()).select("event_id", "state", "retry_count", "priority")


# --- robots rules, made from the pages -------------------------------------

_ROBOTS_TEXT = (
    "# rules\nUser-agent: *\nDisallow: /en/ # english\nAllow: /en/1\n\nUser-Agent: millbot\nUser-agent: other\n"
    "Allow: /fr/\nDisallow: /fr\nCrawl-delay: 2\nDisallow:\n\nDisallow: /lost\nUser-agent: empty\n\n"
    "User-agent: slow\nDisallow: /%7Ea b\nSitemap: /x"
)


def robots_files(spark, folder):
    """One robots text per origin of the pages."""
    origins = table(spark, folder, "pages").select(url_origin(F.col("url")).alias("origin")).distinct()
    return origins.select(
        "origin", F.lit("2024-01-01").cast("timestamp").alias("fetched_at"), F.lit(200).alias("status"),
        F.lit(_ROBOTS_TEXT).alias("body"),
    )


@query(f"""
WITH {SQL_URL_PARTS}, origins AS (SELECT DISTINCT scheme || '://' || domain AS origin FROM parts),
rules AS (SELECT * FROM (VALUES ('*', 2, false, '/en/'), ('*', 3, true, '/en/1'), ('millbot other', 7, true, '/fr/'),
  ('millbot other', 8, false, '/fr'), ('millbot other', 10, true, ''), ('slow', 16, false, '/~a%20b')) AS t(agents, line, allow, path))
SELECT origin, agents, line, allow, path FROM origins, rules""")
def robots_rules(spark, folder):
    rules = robots.robots_rules(robots_files(spark, folder))
    return rules.select("origin", F.array_join("agents", " ").alias("agents"), F.explode("rules").alias("r")).select(
        "origin", "agents", "r.line", "r.allow", "r.path"
    )


@query(f"""
WITH {SQL_URL_PARTS}
SELECT page_id, gone OR NOT starts_with(path, '/en/') AS anybot, gone OR starts_with(path, '/fr/') OR NOT starts_with(path, '/fr') AS millbot
FROM (SELECT *, length(scheme || '://' || domain) % 2 = 0 AS gone FROM parts)""")
def robots_allowed(spark, folder):
    """Each origin has an old file that forbids all; where its length is even, the newest fetch found none."""
    newer = robots_files(spark, folder)
    older = newer.withColumns({"fetched_at": F.lit("2023-12-31 23:50:00").cast("timestamp"), "body": F.lit("User-agent: *\nDisallow: /")})
    gone = newer.filter(F.length("origin") % 2 == 0).withColumns({
        "fetched_at": F.lit("2024-01-01 00:20:00").cast("timestamp"), "status": F.lit(404), "body": F.lit(None).cast("string")})
    files = written(newer.unionByName(older).unionByName(gone), "robots-files")
    rules = written(robots.robots_rules(files), "robots-rules")
    at = F.lit("2024-01-01 00:30:00").cast("timestamp")
    pages = table(spark, folder, "pages").select("page_id", "url")
    for name, agent in (("anybot", "anybot/2.0"), ("millbot", "Millbot/1.0 (+test)")):
        by_origin = robots.latest_rules(robots.agent_rules(rules, agent), files, at)
        pages = robots.robots_allowed(pages, by_origin).withColumnRenamed("allowed", name)
    return pages.drop("url")


@query("""
WITH files AS (SELECT DISTINCT user_id, ts AS fetched_at FROM events WHERE event_type = 'signup')
SELECT e.event_id, CASE WHEN date_diff('microsecond', f.fetched_at, e.ts) < 3600000000 THEN f.fetched_at END AS fetched_at
FROM events e ASOF LEFT JOIN files f ON e.user_id = f.user_id AND e.ts >= f.fetched_at""")
def robots_fresh(spark, folder):
    """For each event the sign-up of the same user that is newest and at most an hour old."""
    events = table(spark, folder, "events").select(
        "event_id", F.col("user_id").cast("string").alias("origin"), as_instant(F.col("ts")).alias("ts"), "event_type"
    )
    files = events.filter(F.col("event_type") == "signup").select("origin", F.col("ts").alias("fetched_at"))
    fresh = robots.fresh_rules_for(events.drop("event_type"), files)
    return fresh.select("event_id", without_zone(F.col("fetched_at")).alias("fetched_at"))


# --- the frontier, made from the pages -------------------------------------


def page_frontier(spark, folder):
    """Every page queued: the language in its address gives the priority, the page id the order."""
    pages = table(spark, folder, "pages").withColumn("lang", F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]+)/", 1))
    priority = F.when(F.col("lang") == "en", 2).when(F.col("lang") == "fr", 3).when(F.col("lang") == "es", 4).otherwise(1)
    return frontier.tasks(pages, 0, priority, seq=F.col("page_id"))


def last_access(spark, folder):
    """Domains of https pages were visited, at a second given by their newest page."""
    pages = table(spark, folder, "pages").filter(F.startswith("url", F.lit("https:")))
    second = F.max("page_id").alias("s")
    return pages.groupBy(url_domain(F.col("url")).alias("domain")).agg(second).select(
        "domain", F.timestamp_seconds(F.lit(1704067200) + F.col("s")).alias("ts")
    )


SQL_FRONTIER = f"""
{SQL_URL_PARTS},
frontier AS (SELECT page_id AS seq, url, domain,
    CASE regexp_extract(path, '^/([a-z]+)/', 1) WHEN 'en' THEN 2 WHEN 'fr' THEN 3 WHEN 'es' THEN 4 ELSE 1 END AS priority FROM parts),
visits AS (SELECT domain, CAST(1704067200 + max(page_id) AS DOUBLE) AS visited FROM parts WHERE scheme = 'https' GROUP BY domain),
slots AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY priority DESC, seq) - 1 AS slot FROM frontier),
planned AS (SELECT s.*, CASE WHEN visited IS NULL THEN CAST(slot AS DOUBLE) ELSE visited + slot + 1 END AS not_before
            FROM slots s LEFT JOIN visits USING (domain))"""


@query(f"WITH {SQL_FRONTIER} SELECT domain, url, priority FROM slots WHERE slot = 0")
def frontier_heads(spark, folder):
    return frontier.domain_heads(page_frontier(spark, folder)).select("domain", "url", "priority")


@query(f"""
WITH {SQL_FRONTIER}
SELECT domain, url, 1704067200.0 + 100 - coalesce(visited, 0) AS idle_seconds FROM slots LEFT JOIN visits USING (domain)
WHERE slot = 0 AND 1704067200.0 + 100 - coalesce(visited, 0) >= 10
ORDER BY priority DESC, idle_seconds DESC, domain LIMIT 20""")
def next_domains(spark, folder):
    """The 20 best domains a delay of ten seconds allows."""
    now = F.timestamp_seconds(F.lit(1704067300))
    due = frontier.next_domains(page_frontier(spark, folder), last_access(spark, folder), now, delay=10.0, k=20)
    return due.select("domain", "url", "idle_seconds")


@query(f"WITH {SQL_FRONTIER} SELECT seq, domain, slot, not_before FROM planned")
def polite_plan(spark, folder):
    plan = frontier.plan_batch(page_frontier(spark, folder), last_access(spark, folder))
    return plan.select("seq", "domain", "slot", "not_before")


@query(f"WITH {SQL_FRONTIER} SELECT seq, domain, slot, not_before FROM planned WHERE slot < 3")
def polite_plan_horizon(spark, folder):
    plan = frontier.plan_batch(page_frontier(spark, folder), last_access(spark, folder), horizon=3.0)
    return plan.select("seq", "domain", "slot", "not_before")


@query(f"WITH {SQL_FRONTIER} SELECT seq, not_before FROM planned WHERE not_before < 5 ORDER BY not_before, priority DESC, seq LIMIT 30")
def plan_limits(spark, folder):
    """At most 30 pages, all starting in the first five seconds."""
    plan = frontier.plan_batch(page_frontier(spark, folder), last_access(spark, folder))
    return frontier.within_limits(plan, max_pages=30, max_duration=5).select("seq", "not_before")


@query(f"WITH {SQL_FRONTIER} SELECT url, domain, 0 AS depth, 3 AS priority FROM frontier")
def seed_frontier(spark, folder):
    return frontier.seed_tasks(table(spark, folder, "pages")).select("url", "domain", "depth", "priority")


@query("""SELECT url, 'https://p.example.org/' || page_id AS parent_url, CAST(page_id AS DOUBLE) AS discovered FROM pages""")
def frontier_json(spark, folder):
    """Frontier rows to JSON text and back."""
    queued = frontier.tasks(
        table(spark, folder, "pages"), 1, 2,
        F.concat(F.lit("https://p.example.org/"), F.col("page_id")), F.timestamp_seconds(F.col("page_id")),
    )
    back = frontier.from_json_rows(frontier.to_json_rows(queued))
    return back.select("url", "parent_url", (F.unix_micros("discovered_time") / 1_000_000).alias("discovered"))


_SQL_TARGETS = f"""
{SQL_PARSED},
edges AS (SELECT url AS parent_url, language, unnest(links) AS url FROM parsed),
done AS (SELECT DISTINCT url FROM edges WHERE language = 'en'),
targets AS (SELECT url, min(parent_url) AS parent_url FROM edges GROUP BY url)"""


def page_records(spark, folder):
    return written(extract_pages(table(spark, folder, "pages")).select("page_id", "url", "language", "links"), "page-links")


def processed_urls(records):
    """Links of the English pages count as processed already."""
    return records.filter(F.col("language") == "en").select(F.explode("links").alias("url"))


@query(f"WITH {SQL_PARSED} SELECT url AS parent_url, unnest(links) AS url, 1 AS depth, 2 AS priority FROM parsed")
def link_edges(spark, folder):
    return graph.link_edges(page_records(spark, folder))


@query(f"WITH {_SQL_TARGETS} SELECT url, 1 AS depth, parent_url FROM targets WHERE url NOT IN (SELECT url FROM done)")
def one_hop_new_links(spark, folder):
    records = page_records(spark, folder)
    return graph.one_hop(records, processed_urls(records))


def _candidates(records):
    edges = graph.link_edges(records)
    return frontier.tasks(edges, F.col("depth"), F.col("priority"), F.col("parent_url"))


@query(f"WITH {_SQL_TARGETS} SELECT url, parent_url, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS domain FROM targets WHERE url NOT IN (SELECT url FROM done)")
def frontier_new_tasks(spark, folder):
    records = page_records(spark, folder)
    return frontier.new_tasks(_candidates(records), processed_urls(records)).select("url", "parent_url", "domain")


@query(f"""
WITH {SQL_PARSED}, rows AS (SELECT page_id, len(string_split(regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1), '/')) AS depth FROM parsed)
SELECT page_id, CAST(depth AS INTEGER) AS depth FROM rows WHERE depth <= 2""")
def depth_limited(spark, folder):
    """Queued pages within a depth bound; the number of path parts stands for the depth."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]*/([^?#]*)", 1)
    queued = table(spark, folder, "pages").select("page_id", F.size(F.split(path, "/")).alias("depth"))
    return frontier.depth_filter(queued, 2)


@query(f"WITH {_SQL_TARGETS} SELECT count(*) AS added FROM targets WHERE url NOT IN (SELECT url FROM done)")
def frontier_added(spark, folder):
    records = page_records(spark, folder)
    return frontier.count_added(_candidates(records), processed_urls(records))


@query(f"WITH {_SQL_TARGETS} SELECT url FROM targets WHERE url NOT IN (SELECT url FROM done)")
def processed_set_add(spark, folder):
    records = page_records(spark, folder)
    return frontier.add_to_set(processed_urls(records).distinct(), graph.link_edges(records), "url")


SQL_FRONTIER_STATS = f"""
{_SQL_TARGETS}, queued AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM pages),
done_domains AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM done),
frontier_stats AS (SELECT (SELECT count(*) FROM queued) AS total_queued, (SELECT count(DISTINCT domain) FROM queued) AS domains_with_urls,
  (SELECT count(*) FROM done) AS total_processed,
  (SELECT count(*) FROM (SELECT domain FROM queued UNION SELECT domain FROM done_domains)) AS total_domains)"""


@query(f"WITH {SQL_FRONTIER_STATS} SELECT * FROM frontier_stats")
def frontier_stats(spark, folder):
    records = page_records(spark, folder)
    return frontier.frontier_stats(page_frontier(spark, folder), processed_urls(records))


@query(f"""
WITH {SQL_FRONTIER}
SELECT seq, url, CASE WHEN seq % 5 = 1 THEN 1 ELSE priority END AS priority FROM frontier WHERE seq % 5 <> 2 OR seq % 2 = 1""")
def frontier_saved(spark, folder):
    """The frontier after four runs: a snapshot, pages queued, pages taken and tried again, pages taken and queued later."""
    path, queue = work_folder(spark, "frontier"), written(page_frontier(spark, folder), "queue")
    fifth = F.col("seq") % 5
    save_frontier(queue.filter(fifth.isin(0, 1)), path, run=1)
    log_frontier(path, 2, added=queue.filter(fifth > 1))
    log_frontier(path, 3, added=queue.filter(fifth == 1).withColumn("priority", F.lit(1)), removed=queue.filter(fifth.isin(1, 2)))
    log_frontier(path, 4, added=queue.filter((fifth == 2) & (F.col("seq") % 2 == 1)))
    snapshot_frontier(spark, path, 3, FRONTIER)
    return load_frontier(spark, path, 4, FRONTIER).select("seq", "url", "priority")


@query("""SELECT 'queued' AS part, (SELECT count(*) FROM pages) = 0 AS is_empty
UNION ALL SELECT 'ftp', (SELECT count(*) FROM pages WHERE url LIKE 'ftp:%') = 0
UNION ALL SELECT 'https', (SELECT count(*) FROM pages WHERE url LIKE 'https:%') = 0""")
def frontier_empty(spark, folder):
    """Is anything queued, at all or of a scheme?"""
    queue = page_frontier(spark, folder)
    parts = [("queued", queue), *((p, queue.filter(F.startswith("url", F.lit(f"{p}:")))) for p in ("ftp", "https"))]
    flags = [frontier.empty_flag(rows).select(F.lit(part).alias("part"), "is_empty") for part, rows in parts]
    return flags[0].unionByName(flags[1]).unionByName(flags[2])


@query("""
SELECT 'https://u.example.org/' || user_id AS url, 3 AS priority FROM events GROUP BY user_id
HAVING date_diff('microsecond', max(ts), TIMESTAMP '2024-01-31') >= 172800000000""")
def recrawl_list(spark, folder):
    """Users as pages: due again two days after their last event."""
    crawls = table(spark, folder, "events").select(
        F.concat(F.lit("https://u.example.org/"), F.col("user_id")).alias("url"), as_instant(F.col("ts")).alias("ts")
    )
    now = as_instant(F.lit("2024-01-31").cast("timestamp_ntz"))
    return recrawl_due(crawls, now, 2 * 86400).select("url", "priority")


# --- a connected crawl, made from the pages --------------------------------

_FANOUT = 8


def _numbered_pages(spark, folder):
    """The pages under addresses that are unique without their fragment."""
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?p="), F.col("page_id"))
    return table(spark, folder, "pages").withColumn("url", url)


def linked_pages(spark, folder):
    """The pages as a tree of links, each with a mirror copy under another address.

    Page n links to its mirror and to pages 8n+1 to 8n+8; a mirror has the
    same content and links as its page.  Every third page is stored under
    another form of its address, and of every fifth there is an older version
    with other content and links, which must not count.
    """
    pages = _numbered_pages(spark, folder)
    children = (
        pages.filter(F.col("page_id") > 0)
        .select(F.floor((F.col("page_id") - 1) / _FANOUT).alias("page_id"), F.concat(F.lit('<a href="'), "url", F.lit('"></a>')).alias("a"))
        .groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_list("a")), "").alias("anchors"))
    )
    mirror = F.concat(F.lit("https://mirror.example.org/"), F.col("page_id"))
    own = F.concat(F.lit('<a href="'), mirror, F.lit('"></a>'))
    linked = pages.join(children, "page_id", "left").select(
        "page_id", "url", F.lit(2).alias("version"),
        F.replace("html", F.lit("</article>"), F.concat(own, F.coalesce("anchors", F.lit("")), F.lit("</article>"))).alias("html"),
    )
    mirrored = linked.withColumn("url", mirror)
    stored = linked.withColumn("url", F.when(F.col("page_id") % 3 == 0, _loud(F.col("url"))).otherwise(F.col("url")))
    older = linked.filter(F.col("page_id") % 5 == 0).withColumns({
        "url": F.concat("url", F.lit("#old")), "version": F.lit(1), "html": F.lit('<main>gone</main><a href="/gone">x</a>'),
    })
    return stored.unionByName(mirrored).unionByName(older)


def _loud(url):
    """The same address with an upper-case host and a fragment."""
    host = F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)
    return F.concat(F.regexp_extract(url, "^[a-z]+://", 0), F.upper(host), F.regexp_extract(url, "^[a-z]+://[^/?#]*(.*)$", 1), F.lit("#top"))


def _roots(spark, folder):
    """Pages no other page links to."""
    pages = _numbered_pages(spark, folder).select("page_id", "url")
    parents = pages.select((F.col("page_id")).alias("parent"))
    with_parent = pages.withColumn("parent", F.when(F.col("page_id") > 0, F.floor((F.col("page_id") - 1) / _FANOUT)))
    return with_parent.join(parents, "parent", "left_anti").select("url")


SQL_EDGES = f"""
nodes AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || '?p=' || page_id AS url FROM pages),
tree AS (SELECT p.page_id, c.url AS link FROM nodes p JOIN nodes c ON c.page_id > 0 AND (c.page_id - 1) // {_FANOUT} = p.page_id),
mirrors AS (SELECT page_id, 'https://mirror.example.org/' || page_id AS link FROM nodes),
edges AS (
  SELECT nodes.url AS parent, unnest(links) AS child FROM parsed JOIN nodes USING (page_id)
  UNION ALL SELECT 'https://mirror.example.org/' || page_id,
    unnest(list_transform(links, lambda l: 'https://mirror.example.org' || regexp_replace(l, '^[a-z]+://[^/]*', ''))) FROM parsed
  UNION ALL SELECT url, tree.link FROM tree JOIN nodes USING (page_id)
  UNION ALL SELECT mirrors.link, tree.link FROM tree JOIN mirrors USING (page_id)
  UNION ALL SELECT url, mirrors.link FROM mirrors JOIN nodes USING (page_id)
)"""


@query(f"""
WITH RECURSIVE {SQL_PARSED}, {SQL_EDGES},
walk(url, depth) AS (
  SELECT url, 0 FROM nodes WHERE page_id = 0
  UNION SELECT child, depth + 1 FROM walk JOIN edges ON parent = walk.url WHERE depth < 5 AND child <> walk.url
)
SELECT url, min(depth) AS depth FROM walk GROUP BY url""")
def crawl_depth(spark, folder):
    records = extract_pages(linked_pages(spark, folder)).select("url", "links", "version")
    links = placed_by(graph.current_version(records, ["version"]).drop("version"), "url", "linked-pages")
    return graph.crawl_depth(links, _roots(spark, folder)).select("url", "depth")


# The crawl one URL at a time: ``level`` holds what is left of this depth, ``found`` the links for the next.
SQL_REPLAY = f"""
{SQL_ALL_PAGE_KEYS}, {SQL_EDGES},
places AS (SELECT page_id, url FROM nodes UNION ALL SELECT page_id, link FROM mirrors),
linked AS (SELECT parent, list(DISTINCT child) AS links FROM edges GROUP BY parent),
facts AS MATERIALIZED (
  SELECT places.url, links, [places.url, content_key, fuzzy_key] AS ks
  FROM places JOIN all_page_keys k ON k.id = places.page_id JOIN linked ON linked.parent = places.url),
walk(depth, url, state, level, found, met, taken) AS (
  SELECT 0, NULL::VARCHAR, NULL::VARCHAR, list(url), []::VARCHAR[], list(url), []::VARCHAR[] FROM nodes WHERE page_id = 0
  UNION ALL
  (SELECT depth, url, state, level, CASE WHEN state = 'stored' THEN list_concat(found, links) ELSE found END, met,
    CASE WHEN state = 'stored' THEN list_concat(taken, ks) ELSE taken END
  FROM (
    SELECT w.depth, w.level[1] AS url, w.level[2:] AS level, w.found, w.met, w.taken, f.links, f.ks,
      CASE WHEN f.url IS NULL THEN 'error' WHEN list_has_any(w.taken, f.ks) THEN 'duplicate' ELSE 'stored' END AS state
    FROM walk w LEFT JOIN facts f ON f.url = w.level[1] WHERE len(w.level) > 0)
  UNION ALL
  SELECT depth + 1, NULL, NULL, fresh, []::VARCHAR[], list_concat(met, fresh), taken
  FROM (SELECT *, list_sort(list_filter(list_distinct(found), lambda u: NOT list_contains(met, u))) AS fresh
        FROM walk WHERE len(level) = 0 AND depth < 5)
  WHERE len(fresh) > 0)),
replayed AS (SELECT url, depth, state FROM walk WHERE url IS NOT NULL)"""


@query(f"WITH RECURSIVE {SQL_REPLAY} SELECT url, depth, state FROM replayed")
def crawl_replay(spark, folder):
    """The whole crawl: mirrors turn out to be duplicates, their links are not followed."""
    replayed = replay(page_facts(linked_pages(spark, folder), newest=["version"]), _roots(spark, folder))
    return replayed.select("url", "depth", "state")


@query(f"""WITH RECURSIVE {SQL_REPLAY}
SELECT depth, count(*) AS crawled, count(*) FILTER (state = 'stored') AS stored, count(*) FILTER (state = 'duplicate') AS duplicate,
  count(*) FILTER (state = 'error') AS error FROM replayed GROUP BY depth""")
def crawl_replay_summary(spark, folder):
    return replay_summary(replay(page_facts(linked_pages(spark, folder), newest=["version"]), _roots(spark, folder)))
