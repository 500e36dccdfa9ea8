"""Frontier, robots rules, fetch records, link graph and replay."""

import datetime
import random
import urllib.robotparser

import pytest
from pyspark.sql import functions as F

from pagemill.operators import fetchlog, frontier, graph, robots
from pagemill.plans.crawl import crawl_replay, page_facts, replay_summary
from pagemill.schemas import FETCH_LOG, FRONTIER
from pagemill.streaming.ingest import load_frontier, log_frontier, recrawl_due, save_frontier, snapshot_frontier

EPOCH = datetime.datetime(1970, 1, 1)


def at(seconds):
    return EPOCH + datetime.timedelta(seconds=seconds)


# --- frontier ---------------------------------------------------------------


@pytest.fixture(scope="module")
def queue(spark):
    rng = random.Random(3)
    return [
        (f"http://d{d}/{i}", f"d{d}", 0, rng.randint(1, 4), None, None, 0, i)
        for i, d in enumerate(rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(120))
    ]


def test_domain_order(spark, queue):
    df = spark.createDataFrame(queue, FRONTIER)
    visits = spark.createDataFrame([("d0", at(95)), ("d1", at(50)), ("d1", at(60))], "domain string, ts timestamp")
    heads = {r.domain: r.url for r in frontier.domain_heads(df).collect()}
    best = {}
    for row in queue:
        if row[1] not in best or (-row[3], row[7]) < (-best[row[1]][3], best[row[1]][7]):
            best[row[1]] = row
    assert heads == {d: r[0] for d, r in best.items()}
    due = frontier.next_domains(df, visits, F.lit(at(100)), delay=10.0, k=None).collect()
    assert {(r.domain, r.idle_seconds) for r in due} == {("d1", 40.0), ("d2", 100.0), ("d3", 100.0)}
    first = frontier.next_domains(df, visits, F.lit(at(100)), delay=10.0).first()
    expected = sorted(((-best[d][3], -i, d) for d, i in (("d1", 40), ("d2", 100), ("d3", 100))))[0][2]
    assert first.domain == expected


@pytest.mark.parametrize("horizon", [None, 4.5])
def test_polite_plan_simulated(spark, queue, horizon):
    df = spark.createDataFrame(queue, FRONTIER)
    visits = spark.createDataFrame([("d0", at(1000))], "domain string, ts timestamp")
    delay = 1.5
    plan = frontier.plan_batch(df, visits, delay, horizon).collect()
    expected = {}
    for d in {r[1] for r in queue}:
        ready = 1000 + delay if d == "d0" else 0.0
        for slot, row in enumerate(sorted((r for r in queue if r[1] == d), key=lambda r: (-r[3], r[7]))):
            if horizon is None or slot * delay < horizon:
                expected[row[7]] = (slot, ready)
            ready += delay
    assert {r.seq: (r.slot, r.not_before) for r in plan} == expected


def test_limits_and_stats(spark, queue):
    df = spark.createDataFrame(queue, FRONTIER)
    none = spark.createDataFrame([], "domain string, ts timestamp")
    plan = frontier.plan_batch(df, none)
    assert frontier.within_limits(plan, max_pages=5).count() == 5
    assert frontier.within_limits(plan, max_duration=2).count() == frontier.plan_batch(df, none, horizon=2.0).count()
    assert frontier.within_limits(plan, 0, None).count() == len(queue)
    processed = spark.createDataFrame([("http://d0/x",), ("http://d0/x",), ("http://zz/y",)], "url string")
    stats = frontier.frontier_stats(df, processed).first()
    assert tuple(stats) == (120, 4, 2, 5)
    assert not frontier.is_empty(df) and frontier.is_empty(df.limit(0))
    assert [frontier.empty_flag(d).first().is_empty for d in (df, df.limit(0))] == [False, True]


def test_enqueue_is_a_set(spark):
    candidates = spark.createDataFrame(
        [("http://a/1", "a", 2, 2, "p2"), ("http://a/1", "a", 1, 2, "p9"), ("http://a/1", "a", 1, 3, "p8"), ("http://a/1", "a", 1, 3, "p7"),
         ("http://a/2", "a", 1, 2, "p"), ("http://a/3", "a", 1, 2, "p")],
        "url string, domain string, depth int, priority int, parent_url string",
    ).withColumn("discovered_time", F.lit(None).cast("timestamp")).withColumn("retry_count", F.lit(0))
    processed = spark.createDataFrame([("http://a/2",)], "url string")
    queued = spark.createDataFrame([("http://a/3",)], "url string")
    rows = frontier.new_tasks(candidates, processed, queued).collect()
    assert [(r.url, r.depth, r.priority, r.parent_url) for r in rows] == [("http://a/1", 1, 3, "p7")]
    assert frontier.count_added(candidates, processed).first().added == 2
    assert frontier.depth_filter(candidates, 1).count() == 5


def test_seeds_only_into_an_empty_frontier(spark, queue):
    seeds = spark.createDataFrame([("http://s/1",), ("http://s/1",)], "url string")
    rows = frontier.seed_tasks(seeds).collect()
    assert [(r.url, r.domain, r.depth, r.priority) for r in rows] == [("http://s/1", "s", 0, 3)]
    df = spark.createDataFrame(queue, FRONTIER)
    assert frontier.seed_tasks(seeds, df).count() == 0
    assert frontier.seed_tasks(seeds, df.limit(0)).count() == 1


def test_retries(spark):
    rows = [(0, None, "x", 2), (0, "e", None, 2), (2, "e", None, 2), (3, "e", None, 2), (0, None, "", 2)]
    df = spark.createDataFrame(rows, "retry_count int, error string, content string, priority int")
    out = frontier.retry_transition(df, fetchlog.is_success()).collect()
    assert [(r.state, r.retry_count, r.priority) for r in out] == [
        ("processed", 0, 2), ("queued", 1, 1), ("queued", 3, 1), ("processed", 3, 2), ("queued", 1, 1),
    ]
    out = frontier.retry_transition(df, fetchlog.is_success(), retryable=F.col("error").isNotNull()).collect()
    assert [r.state for r in out] == ["processed", "queued", "queued", "processed", "processed"]


def test_state_between_runs(spark, queue, tmp_path):
    df = spark.createDataFrame(queue, FRONTIER)
    path = str(tmp_path / "frontier")
    assert load_frontier(spark, path, 1, FRONTIER).count() == 0
    save_frontier(df, path, 1)
    save_frontier(df, path, 1)
    assert sorted(map(tuple, load_frontier(spark, path, 1, FRONTIER).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    back = frontier.from_json_rows(frontier.to_json_rows(df.withColumn("discovered_time", F.timestamp_millis(F.lit(1500)))))
    assert back.first().discovered_time == at(1.5) and back.count() == df.count()


def test_frontier_log_equals_the_whole_table(spark, tmp_path):
    """Random changes over several runs, with a snapshot between them, against a dictionary."""
    rng, path, state = random.Random(2), str(tmp_path / "frontier"), {}
    frame = lambda rows: spark.createDataFrame(rows, FRONTIER)
    loaded = lambda run: sorted(map(tuple, load_frontier(spark, path, run, FRONTIER).collect()))
    after = {}
    for run in range(1, 6):
        removed = rng.sample(sorted(state), min(len(state), 6))
        added = [(f"http://d/{rng.randrange(30)}", "d", run, rng.randint(1, 4), "p", None, run, run) for _ in range(8)]
        added = list({row[0]: row for row in added}.values()) + [(u, "d", run, 1, "again", None, 1, run) for u in removed[:2]]
        added = list({row[0]: row for row in added}.values())
        for url in removed:
            state.pop(url)
        state.update({row[0]: row for row in added})
        gone = spark.createDataFrame([(u,) for u in removed], "url string")
        log_frontier(path, run, frame(added), gone)
        if run == 2:
            log_frontier(path, run, frame(added), gone)  # the same run again
        if run == 3:
            snapshot_frontier(spark, path, run, FRONTIER)
        after[run] = sorted(state.values())
    for run, rows in after.items():
        assert loaded(run) == rows
    files = load_frontier(spark, path, 5, FRONTIER).inputFiles()
    assert not any(f"changes/{kind}/run={run}" in f for f in files for kind in ("added", "removed") for run in (1, 2, 3))


def test_recrawl(spark):
    crawls = spark.createDataFrame([("http://a/", at(0)), ("http://a/", at(90)), ("http://b/", at(40))], "url string, ts timestamp")
    assert [r.url for r in recrawl_due(crawls, F.lit(at(100)), 60).collect()] == ["http://b/"]


# --- fetch records ----------------------------------------------------------


def test_fetch_outcomes(spark):
    big = b"x" * (10 * 1024 * 1024)
    rows = [
        ("ok", 200, "text/html; charset=utf-8", "utf-8", "é".encode(), None),
        ("ok", 404, "TEXT/HTML", None, b"gone", None),
        ("timeout", 0, None, None, None, "Request timeout"),
        ("client_error", 0, None, None, None, "Client error: reset"),
        ("unexpected_error", 0, None, None, None, "Unexpected error: x"),
        ("robots_blocked", 403, None, None, None, "Blocked by robots.txt"),
        ("non_text", 200, "image/png", None, b"png", None),
        ("non_text", 200, None, None, b"x", None),
        ("ok", 200, "application/ld+json", None, big, None),
        ("empty", 200, "text/plain", None, big + b"x", None),
        ("empty", 200, "text/plain", None, b"", None),
        ("empty", 200, "text/plain", "no-such", b"x", None),
    ]
    df = spark.createDataFrame(
        [(r[0], at(0), r[1], {}, r[2], r[3], None if r[4] is None else bytearray(r[4]), r[5], 0.1, 0) for r in rows], FETCH_LOG
    )
    read = fetchlog.read_bodies(df)
    assert [r.outcome for r in fetchlog.with_outcome(read).collect()] == [r[0] for r in rows]
    counters = fetchlog.fetch_counters(read).first()
    assert (counters.total_requests, counters.successful_requests, counters.failed_requests, counters.robots_blocked) == (11, 3, 3, 1)
    assert counters.total_bytes == 2 + 4 + len(big) and counters.total_chars == 1 + 4 + len(big)


# --- robots -----------------------------------------------------------------

ROBOTS = [
    "User-agent: *\nDisallow: /a\nAllow: /a/b\n\nUser-agent: mill\nAllow: /a/b\nDisallow: /a\n",
    "User-agent: mill\nUser-agent: other\nDisallow: /x y\nDisallow:\n",
    "# only a comment\n",
    "User-agent: mill\n\nDisallow: /a\n",
    "Disallow: /a\nUser-agent: *\nCrawl-delay: 1\nUser-agent: mill\nDisallow: /%7Ea # c\n",
    "User-agent: *\nDisallow: /\nUser-agent: mill\nDisallow: /q?x=1\nDisallow: *\n",
    "user-AGENT : Mill/9\r\nDISALLOW: /a\r\n",
    "User-agent: *\nAllow: /a\nDisallow: /",
]
PATHS = ["/", "", "/a", "/a/b/c", "/x y", "/x%20y/z", "/~a/1", "/%7Ea", "/q?x=1&y", "/q", "/b#a", "/é"]


@pytest.mark.parametrize("agent", ["mill/1.0", "Other", "nobody"])
def test_robots_against_standard_library(spark, agent):
    files = [(f"http://h{i}", at(0), 200, text) for i, text in enumerate(ROBOTS)] + [("http://gone", at(0), 404, "User-agent: *\nDisallow: /")]
    robots_df = spark.createDataFrame(files, "origin string, fetched_at timestamp, status int, body string")
    urls = [f"http://h{i}{p}" for i in range(len(ROBOTS)) for p in PATHS] + ["http://gone/a", "http://none/a"]
    rules = robots.robots_rules(robots_df)
    by_origin = robots.latest_rules(robots.agent_rules(rules, agent), robots_df, F.lit(at(10)))
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.allowed for r in robots.robots_allowed(df, by_origin, hot_rows=5).collect()}
    expected = {"http://gone/a": True, "http://none/a": True}
    for i, text in enumerate(ROBOTS):
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(text.splitlines())
        expected.update({f"http://h{i}{p}": parser.can_fetch(agent, f"http://h{i}{p}") for p in PATHS})
    assert got == expected


def test_a_newer_file_without_rules_replaces_an_older_one(spark):
    deny, other = "User-agent: *\nDisallow: /", "User-agent: else\nDisallow: /"
    files = spark.createDataFrame(
        [("http://a", at(0), 200, deny), ("http://a", at(1800), 404, None), ("http://b", at(0), 200, deny), ("http://b", at(1800), 200, other), ("http://c", at(0), 200, deny)],
        "origin string, fetched_at timestamp, status int, body string",
    )
    by_origin = robots.latest_rules(robots.agent_rules(robots.robots_rules(files), "mill/1.0"), files, F.lit(at(2400)))
    urls = spark.createDataFrame([("http://a/x",), ("http://b/x",), ("http://c/x",)], "url string")
    assert {r.url: r.allowed for r in robots.robots_allowed(urls, by_origin).collect()} == {"http://a/x": True, "http://b/x": True, "http://c/x": False}


def test_robots_freshness(spark):
    rules = spark.createDataFrame(
        [("o", at(0), [(0, True, "/old")]), ("o", at(100), [(0, True, "/new")]), ("o", at(9000), [(0, True, "/future")]), ("p", at(0), [(0, True, "/")])],
        "origin string, fetched_at timestamp, rules array<struct<line:int,allow:boolean,path:string>>",
    )
    latest = {r.origin: r.rules[0].path for r in robots.latest_rules(rules, rules, F.lit(at(3650))).collect()}
    assert latest == {"o": "/new"}
    rng = random.Random(1)
    files = [("o" if rng.random() < 0.7 else "p", rng.randrange(0, 40000)) for _ in range(40)]
    asked = [(i, "o" if rng.random() < 0.7 else "p", rng.randrange(0, 45000)) for i in range(300)]
    got = robots.fresh_rules_for(
        spark.createDataFrame([(i, o, at(t)) for i, o, t in asked], "i int, origin string, ts timestamp"),
        spark.createDataFrame([(o, at(t)) for o, t in files], "origin string, fetched_at timestamp"),
    ).collect()
    for r in got:
        t = (r.ts - EPOCH).total_seconds()
        fresh = [f for o, f in files if o == r.origin and 0 <= t - f < 3600]
        assert r.fetched_at == (at(max(fresh)) if fresh else None)
    assert len(got) == 300


# --- graph and replay -------------------------------------------------------


def test_crawl_depth(spark):
    links = {"s": ["a", "b", "s"], "a": ["c"], "b": ["c", "t"], "c": ["d"], "d": ["e", "s"], "e": ["f"], "f": ["g"], "t": ["f", "x"]}
    df = spark.createDataFrame([(k, v) for k, v in links.items()], "url string, links array<string>")
    seeds = spark.createDataFrame([("s",), ("e",)], "url string")
    got = {r.url: r.depth for r in graph.crawl_depth(df, seeds, max_depth=3).collect()}
    assert got == {"s": 0, "e": 0, "a": 1, "b": 1, "f": 1, "c": 2, "t": 2, "g": 2, "d": 3, "x": 3}
    assert {r.url for r in graph.crawl_depth(df, seeds, max_depth=0).collect()} == {"s", "e"}
    hop = graph.one_hop(df, seeds)
    assert {r.url for r in hop.collect()} == {"a", "b", "c", "d", "f", "g", "t", "x"}


def simulate(pages, seeds, max_depth, keys, follow):
    """The replay restated row by row; ``keys`` gives a page's set of keys."""
    level, met, taken, out = sorted(seeds), set(seeds), set(), {}
    for depth in range(max_depth + 1):
        found = {}
        for url in level:
            if url not in pages:
                out[url] = (depth, "error")
                continue
            text, links = pages[url]
            duplicate = bool(keys(url, text) & taken)
            out[url] = (depth, "duplicate" if duplicate else "stored")
            if not duplicate:
                taken |= keys(url, text)
            if follow or not duplicate:
                for link in links:
                    found.setdefault(link, url)
        level = sorted(set(found) - met)
        met |= set(level)
    return out


@pytest.mark.parametrize("seed, follow", [(1, False), (2, True)])
def test_replay_matches_simulation(spark, seed, follow):
    rng = random.Random(seed)
    pages = {}
    for i in range(60):
        text = " ".join(f"word{rng.randrange(40)}x" for _ in range(3)) if rng.random() < 0.6 else f"common text number{rng.randrange(4)}"
        pages[f"http://h/{i}"] = (text, [f"http://h/{rng.randrange(75)}" for _ in range(3)])
    rows = [
        (u, f"<main>{text}</main>" + "".join(f'<a href="{link}"></a>' for link in links)) for u, (text, links) in pages.items()
    ] + [("http://h/70", "")]
    facts = page_facts(spark.createDataFrame(rows, "url string, html string"))
    seeds = ["http://h/0", "http://h/5", "http://h/70"]

    def keys(url, text):
        words = sorted(w for w in set(text.split()) if len(w) > 3)
        counts = sorted(((-text.split().count(w), text.split().index(w)), w) for w in words)
        return {("u", url), ("c", text), ("f", len([w for w in text.split() if len(w) > 3]), tuple(w for _, w in counts))}

    got = crawl_replay(facts, spark.createDataFrame([(s,) for s in seeds], "url string"), 4, follow)
    expected = simulate(pages, seeds, 4, keys, follow)
    assert {r.url: (r.depth, r.state) for r in got.collect()} == expected
    total = replay_summary(got).agg(F.sum("crawled"), F.sum("stored")).first()
    assert tuple(total) == (len(expected), sum(s == "stored" for _, s in expected.values()))
    assert {s for _, s in expected.values()} == {"stored", "duplicate", "error"}


def test_one_page_for_each_address(spark):
    rows = [("http://H/c#top", 1, ["http://h/a"]), ("http://h/c", 2, ["http://h/b"]), ("http://h/c#x", None, ["http://h/z"]), ("http://h/C", 1, [])]
    df = spark.createDataFrame(rows, "url string, v int, links array<string>")
    assert sorted(map(tuple, graph.current_version(df, ["v"]).collect())) == [("http://h/C", 1, []), ("http://h/c", 2, ["http://h/b"])]
    ties = spark.createDataFrame([("http://h/a", 1, ["x"]), ("http://h/a#1", 1, ["y"])], df.schema)
    picks = {tuple(graph.current_version(ties.repartition(n).orderBy(o), ["v"]).first().links) for n in (1, 3) for o in ("url", F.desc("url"))}
    assert len(picks) == 1


def test_replay_takes_the_newest_version_of_a_page(spark):
    page = lambda text, *links: f"<main>{text}</main>" + "".join(f'<a href="{link}">x</a>' for link in links)
    rows = [
        ("http://h/s#frag", 5, page("start words here", "http://H/a#1", "/b")), ("http://h/s", 1, page("old start", "/never")),
        ("http://H/a", 3, page("second page text", "/c")), ("http://h/a#2", 2, page("second page older", "/never")),
        ("http://h/b", 9, ""), ("http://h/b#1", 1, page("was here once", "/never")), ("http://h/c", 1, page("third text of all")),
    ]
    facts = page_facts(spark.createDataFrame(rows, "url string, at int, html string"), newest=["at"])
    got = crawl_replay(facts, spark.createDataFrame([("http://H/s#top",), ("http://h/s",)], "url string"))
    assert sorted((r.url, r.depth, r.state) for r in got.collect()) == [
        ("http://h/a", 1, "stored"), ("http://h/b", 1, "error"), ("http://h/c", 2, "stored"), ("http://h/s", 0, "stored"),
    ]
