"""Personal data by bootstrapped contexts, in DataFrame and SQL functions only.

Seeds are what fixed patterns find: addresses of mail and network, card and
phone numbers.  The word before an entity is a lexical pattern.  Identifier-
like tokens after the same words are candidates.  Patterns and instances form
a graph, which is scored in rounds.  A pattern's score is the share of its
occurrences whose instances are seeds or accepted; a candidate is accepted for
a pattern when the mean score of the other patterns it follows is high, so none
raises the pattern it is judged by.  Both are shares of occurrences: more text
of the same kind leaves them where they are, while shares of distinct instances
would rise, as seeds stay new and clean numbers come again.  Candidates of
patterns with high scores are found entities, kind ``context``.

A candidate is a token that has a digit anywhere, without the punctuation at its
ends.  Positions come from splitting a text by a pattern: gaps and matches alternate,
so running sums of their lengths are the places.  Patterns are written with
possessive parts and cannot backtrack over a long text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import text_of
from pagemill.session import written

_LOCAL = r"[A-Za-z0-9._%+-]"
KINDS = ("email", "ip", "card", "phone", "context")
# Equal to the contract's patterns; a start inside a run whose beginning failed is not tried again.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # A whole token with a digit, anywhere in it; its punctuation at both ends is trimmed below.
    "context": r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+",
}
_SIGN, _NO_SIGN = r"[^\p{L}\p{M}\p{N}]", r"[\p{L}\p{M}\p{N}]"
_SPACE = " \t\n\x0b\x0c\r"
_BACK = 40


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 14 to 19 digits pass the check sum."""
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), lambda i: F.substring(digits, -i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(places, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    digits = _digits(found)
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int").isNull() | (F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int") <= 255)))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _last_word(left: Column) -> Column:
    return F.element_at(F.split(F.rtrim(left, F.lit(_SPACE)), r"[\x20\x09-\x0D]"), -1)


def _before(gaps: Column, found: Column, i: Column, kind: str) -> Column:
    """The word that ends before match ``i``, at any distance of white space and of any length.

    It may begin in earlier matches; of those that touch each other it reaches back over ``_BACK``.
    """
    gap = F.rtrim(F.get(gaps, i), F.lit(_SPACE))
    if kind == "context":  # a match ends where white space begins, so the word is in the gap or the match before
        word = F.when((gap == "") & (i > 0), F.get(found, i - 1)).otherwise(_last_word(gap))
    else:
        back = F.transform(F.sequence(F.greatest(i - _BACK, F.lit(0)), i - 1), lambda j: F.concat(F.get(gaps, j), F.get(found, j)))
        inside = (i == 0) | gap.rlike(r"[\x20\x09-\x0D]")
        word = F.when(inside, _last_word(gap)).otherwise(_last_word(F.concat(F.array_join(back, ""), gap)))
    return F.lower(word)


def _matches(text: Column, kind: str) -> Column:
    """``kind``, ``k``, ``gap`` (code points before, since the last match), ``size``, ``lead`` and ``tail`` (trimmed off), ``instance`` and the word ``before``, in order.

    Matches and gaps are bound once for a text; each match then looks at its own.
    """
    pattern = PATTERNS[kind]
    def one(m: Column, i: Column, found: Column, gaps: Column) -> Column:  # noqa: E306
        headless = F.regexp_replace(m, rf"\A{_SIGN}++", "") if kind == "context" else m
        core = F.regexp_replace(headless, rf"(?<={_NO_SIGN}){_SIGN}++\z", "") if kind == "context" else m
        size = lambda c: F.length(c).cast("long")
        valid = _valid(kind, m)
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("k"), size(F.get(gaps, i)).alias("gap"), size(m).alias("size"),
            (size(m) - size(headless)).alias("lead"), (size(headless) - size(core)).alias("tail"), valid.alias("valid"), F.sha2(core, 256).alias("instance"),
            F.when(valid, _before(gaps, found, i, kind)).otherwise("").alias("before"),
        )
    bound = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")))  # noqa: E305
    return F.element_at(F.transform(bound, lambda b: F.transform(b["found"], lambda m, i: one(m, i, b["found"], b["gaps"]))), 1)


def _mark(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``row``, ``id``, ``kind``, ``start``, ``stop``, ``instance``, ``before``, ``valid`` of all matches; rows without matches have one with null ``kind``."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("mark", _mark(F.col("text")))
    every = F.flatten(F.array(*(_matches(F.col("text"), kind) for kind in KINDS)))
    out = rows.select("row", "id", "mark", F.explode_outer(every).alias("m")).select("row", "id", "mark", "m.*").repartition("row")
    order = Window.partitionBy("row", "kind").orderBy("k")
    stop = F.sum(F.col("gap") + F.col("size")).over(order)
    start = F.col("stop") - F.col("size") + F.col("lead")
    return out.withColumn("stop", stop).select("row", "id", "mark", "kind", start.alias("start"), (F.col("stop") - F.col("tail")).alias("stop"), "valid", "instance", "before")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, least_score: float = 0.8, least_seeds: int = 3, least_share: float = 0.1) -> DataFrame:
    """``row``, ``id``, ``mark`` (hash of the text) and ``found``: the sorted spans ``(start, kind number, stop, kind, reach)`` of each row of ``df``; empty where there are none.

    ``reach`` is the furthest stop of the spans before.

    Null texts count as empty.  Base spans always stay; a context span is added
    where it touches none of them and its pattern has a score of ``least_score``,
    ``least_seeds`` seeds and seeds for a share of ``least_share`` of its
    occurrences; the last keeps a frequent word from passing by a count alone.
    Repeated rows have equal spans of their own.
    """
    every = written(spans(df, id_col, text_col), "pii-spans")
    good = every.filter("valid")
    base, other = good.filter("kind <> 'context'"), good.filter("kind = 'context'")
    # A candidate that overlaps a base span is that entity, not a new one.  Spans in order of start: the furthest stop before and the next start after.
    line = Window.partitionBy("row").orderBy("start", F.col("kind") == "context")
    is_base = F.col("kind") != "context"
    beside = good.withColumn("reach", F.max(F.when(is_base, F.col("stop"))).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    # Backwards, as a frame that ends with the partition would be summed up anew for every row.
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc(F.col("kind") == "context"))
    beside = beside.withColumn("next", F.min(F.when(is_base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    free = ~is_base & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("stop")) >= F.col("stop"))
    candidates = written(beside.filter(free).drop("reach", "next"), "pii-candidates")
    edges = written(
        base.unionByName(candidates).filter("before <> ''").groupBy("before", "instance").agg(F.max(F.col("kind") != "context").cast("double").alias("seed"), F.count(F.lit(1)).alias("n")), "pii-graph",
    )
    share = lambda good: F.sum(F.when(good, F.col("n")).otherwise(0)) / F.sum("n")
    is_seed = F.col("seed") == 1
    patterns = edges.groupBy("before").agg(share(is_seed).alias("p"))
    for _ in range(rounds):
        judged = edges.join(patterns.select("before", "p"), "before")
        whole = judged.groupBy("instance").agg(F.sum(F.col("n") * F.col("p")).alias("mass"), F.sum("n").alias("times"))
        others = (F.col("mass") - F.col("n") * F.col("p")) / F.nullif(F.col("times") - F.col("n"), F.lit(0))
        accepted = is_seed | (F.coalesce(others, F.lit(0.0)) >= least_score)
        patterns = written(judged.join(whole, "instance").groupBy("before").agg(
            share(accepted).alias("p"), F.sum("seed").alias("seeds"), share(is_seed).alias("share")), "pii-scores")
    strong = patterns.filter((F.col("p") >= least_score) & (F.col("seeds") >= least_seeds) & (F.col("share") >= least_share)).select("before")
    added = candidates.join(strong, "before", "left_semi")
    chosen = base.unionByName(added).withColumn("rank", _rank(F.col("kind")))
    earlier = Window.partitionBy("row").orderBy("start", "rank", "stop").rowsBetween(Window.unboundedPreceding, -1)
    entry = F.struct("start", "rank", "stop", "kind", F.coalesce(F.max("stop").over(earlier), F.lit(0)).alias("reach"))
    found = chosen.select("row", entry.alias("entry")).groupBy("row").agg(F.sort_array(F.collect_list("entry")).alias("found"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string,reach:bigint>>")
    return every.select("row", "id", "mark").distinct().join(found, "row", "left").select("row", "id", "mark", F.coalesce("found", empty).alias("found"))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*(F.lit(k) for k in KINDS)), kind).cast("int")


def _line(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def pii_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """For each row its counts per base kind, a digest of the base spans and a line of all spans."""
    found = find(df, id_col, text_col, **options)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != "context")
    return found.select(F.col("id").alias(id_col), *(count(k) for k in KINDS[:4]), F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("found")).alias("spans"), count("context"))


def masked(text: Column, spans_col: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans only the first to begin is named, all their characters go.

    In UTF-32 every code point has four bytes, so a span's place needs no search and the work is linear in the text.
    """
    def cut(b: Column, start: Column, stop: Column) -> Column:
        return F.decode(F.substring(b, (start * 4 + 1).cast("int"), (F.greatest(stop - start, F.lit(0)) * 4).cast("int")), "UTF-32")

    def piece(b: Column, s: Column) -> Column:
        return F.when(s["start"] >= s["reach"], F.concat(cut(b, s["reach"], s["start"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise("")

    def whole(b: Column) -> Column:
        last = F.element_at(spans_col, -1)
        rest = cut(b, F.greatest(last["reach"], last["stop"]), F.octet_length(b) / 4)
        return F.concat(F.array_join(F.transform(spans_col, lambda s: piece(b, s)), ""), rest)

    return F.element_at(F.transform(F.array(F.encode(text, "UTF-32")), whole), 1)


def mask(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with the spans in its texts replaced by their kinds; texts without any, null ones too, stay as they are.

    Rows get the spans of their id and text; columns keep their names, whatever these are.
    """
    names = {c.lower() for c in df.columns}
    own = {}
    for name in ("id", "mark", "found"):
        own[name] = f"_{name}"
        while own[name].lower() in names:
            own[name] = f"_{own[name]}"
    hits = find(df, id_col, text_col, **options).filter(F.size("found") > 0)
    hits = hits.groupBy(F.col("id").alias(own["id"]), F.col("mark").alias(own["mark"])).agg(F.first("found").alias(own["found"]))
    met = df.join(hits, F.col(f"`{id_col}`").eqNullSafe(F.col(own["id"])) & (_mark(text_of(text_col)) == F.col(own["mark"])), "left")
    clean = F.when(F.col(own["found"]).isNull(), F.col(f"`{text_col}`")).otherwise(masked(text_of(text_col), F.col(own["found"])))
    return met.withColumn(text_col, clean).select(*(F.col(f"`{c}`") for c in df.columns))
