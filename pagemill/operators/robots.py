"""Robots rules as a relation, and the filter that applies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.urls import let, url_local_part, url_origin
from pagemill.functions.values import ROBOTS_TTL_SECONDS
from pagemill.operators.skew import HOT_ROWS, hot_keys, salted_join


def _quoted(text: Column) -> Column:
    """Percent-encode a path one way, whatever mixture of escapes it came in."""
    plain = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    encoded = F.url_encode(F.coalesce(F.try_url_decode(plain), text))
    for old, new in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(old), F.lit(new))
    # Most paths hold only characters that stand for themselves.
    return F.when(text.rlike(r"^[A-Za-z0-9_.~/-]*$"), text).otherwise(encoded)


def robots_rules(robots: DataFrame) -> DataFrame:
    """Robots texts (``origin``, ``fetched_at``, ``status``, ``body``) to rule groups.

    One row per group of a file: ``agents`` and its rules ``(line, allow, path)``
    in file order.  Windows run over the lines of one file, whose size the
    body limit bounds.  Files that are missing, not 200 or empty give no rows,
    which allows everything.
    """
    file = ["origin", "fetched_at"]
    ordered = Window.partitionBy(*file).orderBy("line")
    lines = (
        robots.filter((F.col("status") == 200) & (F.coalesce(F.col("body"), F.lit("")) != ""))
        .select(*file, F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line", "raw"))
        .withColumn("text", F.trim(F.regexp_replace("raw", "#.*$", "")))
        .withColumn("key", F.lower(F.trim(F.substring_index("text", ":", 1))))
        .withColumn(
            "kind",
            F.when(F.col("raw") == "", F.lit("blank"))
            .when(~F.contains("text", F.lit(":")), F.lit(None))
            .when(F.col("key") == "user-agent", F.lit("agent"))
            .when(F.col("key").isin("allow", "disallow", "crawl-delay", "request-rate"), F.lit("rule")),
        )
        .filter(F.col("kind").isNotNull())
        .withColumn("value", F.trim(F.substr("text", F.length(F.substring_index("text", ":", 1)) + 2)))
    )
    # A blank line ends a group; so does an agent line that follows a rule.
    starts = (F.col("kind") == "blank") | ((F.col("kind") == "agent") & (F.col("previous") == "rule"))
    grouped = lines.withColumn("previous", F.lag("kind").over(ordered)).withColumn(
        "group", F.sum(F.when(starts, 1).otherwise(0)).over(ordered)
    )
    # An empty Disallow allows everything.
    allow = (F.col("key") == "allow") | (F.col("value") == "")
    rule = F.struct(F.col("line"), allow.alias("allow"), _quoted(F.col("value")).alias("path"))
    first_agent = F.min(F.when(F.col("kind") == "agent", F.col("line")))
    return (
        grouped.groupBy(*file, "group")
        .agg(
            first_agent.alias("first_agent"),
            F.count_if(F.col("kind") == "rule").alias("n_rules"),
            F.sort_array(
                F.collect_list(F.when(F.col("kind") == "agent", F.struct("line", F.lower("value").alias("agent"))))
            ).alias("agents"),
            F.sort_array(F.collect_list(F.when(F.col("key").isin("allow", "disallow"), rule))).alias("rules"),
        )
        .filter(F.col("first_agent").isNotNull() & (F.col("n_rules") > 0))
        .select(*file, "group", F.col("agents")["agent"].alias("agents"), "rules")
    )


def agent_rules(rules: DataFrame, agent: str) -> DataFrame:
    """The one group per file that governs ``agent``: a named group before '*'."""
    name = agent.split("/")[0].lower()
    default = F.array_contains("agents", "*")
    named = F.exists("agents", lambda a: F.contains(F.lit(name), a))
    return (
        rules.filter(default | named)
        .groupBy("origin", "fetched_at")
        .agg(F.min_by("rules", F.struct(default, F.col("group"))).alias("rules"))
    )


def latest_rules(
    rules: DataFrame, files: DataFrame, at: Column, ttl_seconds: int = ROBOTS_TTL_SECONDS
) -> DataFrame:
    """Per origin, the rules of the newest of ``files`` fetched within ``ttl_seconds`` before ``at``.

    The file is chosen among all fetches, so one that is missing or has no
    rules for the agent still takes the place of an older one: its origin has
    no row here, which allows everything.
    """
    age = F.unix_micros(at) - F.unix_micros("fetched_at")
    fresh = files.filter((age >= 0) & (age < ttl_seconds * 1_000_000))
    newest = fresh.groupBy("origin").agg(F.max("fetched_at").alias("fetched_at"))
    return rules.join(newest, ["origin", "fetched_at"], "left_semi").select("origin", "rules")


def rule_verdict(url: Column, rules: Column) -> Column:
    """First rule in file order whose path starts the URL's; none allows."""

    def first(path: Column) -> Column:
        hit = F.filter(rules, lambda r: F.startswith(path, r["path"]))
        return F.coalesce(F.get(hit, F.lit(0))["allow"], F.lit(True))

    local = _quoted(url_local_part(url))
    return F.when(rules.isNull(), F.lit(True)).otherwise(
        let(F.when(local == "", F.lit("/")).otherwise(local), first)
    )


def robots_allowed(urls: DataFrame, rules_by_origin: DataFrame, url: str = "url", **skew) -> DataFrame:
    """Adds ``allowed``.  The join is on the origin; hot origins are spread."""
    facts = urls.withColumn("origin", url_origin(F.col(url)))
    joined = salted_join(facts, rules_by_origin.select("origin", "rules"), ["origin"], "left", [url], **skew)
    return joined.withColumn("allowed", rule_verdict(F.col(url), F.col("rules"))).drop("origin", "rules")


def fresh_rules_for(
    requests: DataFrame, files: DataFrame, ttl_seconds: int = ROBOTS_TTL_SECONDS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """As-of join: each request (``origin``, ``ts``) gets the newest file in its last ``ttl_seconds``.

    Time is cut into cells of one TTL; a file counts in its own cell and the
    next, so a request looks only at its cell.  A cell with more than
    ``hot_rows`` requests is cut into parts of that size, to which its few
    files are copied.  Adds ``fetched_at``, null where no file is fresh.
    ``requests`` is read twice.
    """
    cell = F.floor(F.unix_micros("ts") / F.lit(ttl_seconds * 1_000_000))
    celled = requests.withColumn("_cell", cell)
    hot = hot_keys(celled, ["origin", "_cell"], hot_rows).withColumnRenamed("salts", "_salts")
    parts = F.coalesce("_salts", F.lit(1).cast("bigint"))
    asked = celled.join(hot, ["origin", "_cell"], "left").select(
        *requests.columns, "_cell", F.pmod(F.xxhash64(*requests.columns), parts).alias("_salt"), F.lit(None).cast("timestamp").alias("_file"),
    )
    known = (
        files.select("origin", F.col("fetched_at").alias("ts")).distinct()
        .withColumn("_file", F.col("ts"))
        .withColumn("_cell", F.explode(F.array(cell, cell + 1)))
        .join(hot, ["origin", "_cell"], "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_salts")
    )
    window = (
        Window.partitionBy("origin", "_cell", "_salt")
        .orderBy(F.col("ts"), F.col("_file").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    newest = F.last("_file", ignorenulls=True).over(window)
    both = asked.unionByName(known, allowMissingColumns=True).withColumn("_newest", newest)
    age = F.unix_micros("ts") - F.unix_micros("_newest")
    return both.filter(F.col("_file").isNull()).select(
        *requests.columns,
        F.when(age < ttl_seconds * 1_000_000, F.col("_newest")).alias("fetched_at"),
    )
