"""Domain lists that are tables rather than short configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.skew import salted_join


def matching_domains(domains: DataFrame, entries: DataFrame, match: str = "substring") -> DataFrame:
    """Distinct ``domain`` values that match some ``entry``.

    A substring test has no join key, so every domain is cut into its
    substrings of those lengths that occur among the entries and are not above
    its own, and these are joined by equality.
    """
    distinct = domains.select("domain").distinct()
    entries = entries.select(F.lower("entry").alias("piece")).filter(F.col("piece") != "").distinct()
    if match == "suffix":
        labels = F.split("domain", r"\.")
        pieces = F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        )
        cut = distinct.withColumn("piece", F.explode(pieces))
    else:
        lengths = F.lit([r["n"] for r in entries.select(F.length("piece").alias("n")).distinct().collect()]).cast("array<int>")
        own = F.length("domain")

        def pieces_of(n):
            return F.transform(F.sequence(F.lit(1), own - n + 1), lambda i: F.substring("domain", i, n))

        whole = F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda n: n <= own), pieces_of)))
        cut = distinct.withColumn("piece", F.explode(whole))
    return cut.join(entries, "piece", "left_semi").select("domain").distinct()


def filter_domains(
    urls: DataFrame, allowed: DataFrame | None = None, blocked: DataFrame | None = None, match: str = "substring"
) -> DataFrame:
    """Keep rows of ``urls`` (``url``, ``domain``) that no list rejects."""
    out = urls
    if blocked is not None:
        out = salted_join(out, matching_domains(urls, blocked, match), ["domain"], "left_anti", ["url"])
    if allowed is not None:
        out = salted_join(out, matching_domains(urls, allowed, match), ["domain"], "left_semi", ["url"])
    return out.select(*urls.columns)
