"""URL columns: splitting, resolving, normalising, filtering, hashing.

Everything is a plain Column expression (no UDF).  One regular expression
cuts a URL into its parts and matches any text, so a bad URL in page data
cannot fail a job under ANSI mode.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.values import SKIP_EXTENSIONS, TRACKING_PARAMS, WS

_CONTROL_OR_SPACE = "".join(chr(i) for i in range(0x21))
_CUT = "\x01"

# RFC 3986 appendix B, with the ;params of the last segment apart.  A lone
# ';', '?' or '#' counts as absent.
_PARTS = (
    r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?"
    r"((?:[^?#]*/)?[^?#/;]*)(;[^?#/]+)?;?(\?[^#]+)?\??(#.+)?#?$"
)
_SCHEME, _AUTHORITY, _PATH, _PARAMS, _QUERY, _FRAGMENT = range(6)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def url_parts(url: Column) -> Column:
    """Array of scheme ('http:', lower case), authority ('//host'), path, ';params', '?query', '#fragment'."""
    text = F.translate(F.ltrim(url, F.lit(_CONTROL_OR_SPACE)), "\t\r\n" + _CUT, "")
    cut = F.split(F.regexp_replace(text, _PARTS, _CUT.join(f"${i}" for i in range(1, 7))), _CUT)
    return let(cut, lambda p: F.array(F.lower(p[_SCHEME]), *[p[i] for i in range(_AUTHORITY, _FRAGMENT + 1)]))


def _malformed(p: Column) -> Column:
    """An unbalanced bracket makes the authority unreadable."""
    return F.contains(p[_AUTHORITY], F.lit("[")) != F.contains(p[_AUTHORITY], F.lit("]"))


def _has_host(p: Column) -> Column:
    return F.length(p[_AUTHORITY]) > 2


def url_domain(url: Column) -> Column:
    """Authority with port, lower case; '' if there is none, 'unknown' if unreadable."""
    return let(
        url_parts(url),
        lambda p: F.when(url.isNull() | _malformed(p), F.lit("unknown")).otherwise(
            F.lower(F.substr(p[_AUTHORITY], F.lit(3)))
        ),
    )


def url_origin(url: Column) -> Column:
    """``scheme://authority``: the key under which robots rules apply."""
    return let(
        url_parts(url),
        lambda p: F.concat(p[_SCHEME], F.when(p[_AUTHORITY] == "", F.lit("//")).otherwise(p[_AUTHORITY])),
    )


def url_local_part(url: Column) -> Column:
    """Everything after the authority: what robots rules are matched against."""
    return let(url_parts(url), lambda p: F.concat(*[p[i] for i in range(_PATH, _FRAGMENT + 1)]))


def _light(p: Column) -> Column:
    return F.concat(p[_SCHEME], F.lower(p[_AUTHORITY]), p[_PATH], p[_PARAMS], p[_QUERY])


def normalize_url(url: Column) -> Column:
    """Light form: lower-case authority, no fragment; path and query keep their case."""
    return let(url_parts(url), lambda p: F.when(_malformed(p), url).otherwise(_light(p)))


# --- canonical key ---------------------------------------------------------


def decode_escapes(text: Column) -> Column:
    """Undo form encoding; a percent sign that starts no escape stands for itself."""
    safe = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), text)


def encode_escapes(text: Column) -> Column:
    """Form encoding with '~' left alone and '*' escaped."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_query(query: Column) -> Column:
    """Drop tracking and blank parameters, sort by key, re-encode."""
    pairs = F.transform(
        F.split(query, "&"),
        lambda part, i: F.struct(
            decode_escapes(F.substring_index(part, "=", 1)).alias("k"),
            i.alias("i"),
            F.substr(part, F.length(F.substring_index(part, "=", 1)) + 2).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: (p["v"] != "") & ~p["k"].isin(*TRACKING_PARAMS))
    return F.array_join(
        F.transform(
            F.sort_array(kept),
            lambda p: F.concat(encode_escapes(p["k"]), F.lit("="), encode_escapes(decode_escapes(p["v"]))),
        ),
        "&",
    )


def canonical_url_key(url: Column) -> Column:
    """Heavy form, for duplicate detection: one spelling per page address."""

    def rebuilt(p: Column) -> Column:
        path = F.when(
            (F.length(p[_PATH]) > 1) & F.endswith(p[_PATH], F.lit("/")),
            F.substr(p[_PATH], F.lit(1), F.length(p[_PATH]) - 1),
        ).otherwise(p[_PATH])
        query = F.when(p[_QUERY] == "", F.lit("")).otherwise(
            let(
                canonical_query(F.substr(p[_QUERY], F.lit(2))),
                lambda q: F.when(q == "", q).otherwise(F.concat(F.lit("?"), q)),
            )
        )
        return F.when(_malformed(p), F.lower(url)).otherwise(
            F.concat(p[_SCHEME], p[_AUTHORITY], path, p[_PARAMS], query)
        )

    return let(url_parts(F.lower(url)), rebuilt)


# --- resolving -------------------------------------------------------------


def _remove_dot_segments(path: Column) -> Column:
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(
            seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).when(seg == ".", acc).otherwise(F.concat(acc, F.array(seg))),
    )
    closed = F.when(
        F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))
    ).otherwise(kept)
    return F.concat(F.lit("/"), F.ltrim(F.array_join(closed, "/"), F.lit("/")))


def _merged_path(b: Column, h: Column) -> Column:
    # A relative path goes into the base's folder; empty inner segments are dropped there.
    folder = F.regexp_replace(b[_PATH], "[^/]*$", "")
    merged = F.when(F.startswith(h[_PATH], F.lit("/")), h[_PATH]).otherwise(
        F.concat(F.lit("/"), F.regexp_replace(F.concat(folder, h[_PATH]), r"^/+|(?<=/)/+", ""))
    )
    return let(
        merged, lambda m: F.when(m.rlike(r"/\.\.?(/|$)"), _remove_dot_segments(m)).otherwise(m)
    )


def resolved_parts(b: Column, h: Column) -> Column:
    """Parts of reference ``h`` resolved against base ``b`` (both from :func:`url_parts`)."""

    def combine(*columns: Column) -> Column:
        return F.array(*columns)

    blank = F.array_join(h, "") == ""
    foreign = ((h[_SCHEME] != "") & (h[_SCHEME] != b[_SCHEME])) | ~b[_SCHEME].isin("http:", "https:", "ftp:")
    here = (h[_PATH] == "") & (h[_PARAMS] == "")
    return (
        F.when(blank, b)
        .when(foreign, h)
        .when(_has_host(h), combine(b[_SCHEME], *[h[i] for i in range(_AUTHORITY, _FRAGMENT + 1)]))
        .when(
            here,
            combine(
                b[_SCHEME], b[_AUTHORITY], b[_PATH], b[_PARAMS],
                F.when(h[_QUERY] == "", b[_QUERY]).otherwise(h[_QUERY]), h[_FRAGMENT],
            ),
        )
        .otherwise(
            combine(b[_SCHEME], b[_AUTHORITY], _merged_path(b, h), h[_PARAMS], h[_QUERY], h[_FRAGMENT])
        )
    )


def resolve_url(base: Column, href: Column) -> Column:
    """RFC 3986 reference resolution of ``href`` against ``base``."""
    return let(
        url_parts(base),
        lambda b: let(url_parts(href), lambda h: F.array_join(resolved_parts(b, h), "")),
    )


# --- filtering -------------------------------------------------------------


def _valid(
    p: Column, allowed: Sequence[str], blocked: Sequence[str], check_extension: bool, match: str
) -> Column:
    domain = F.lower(F.substr(p[_AUTHORITY], F.lit(3)))

    def hit(entries: Sequence[str]) -> Column:
        if match == "suffix":
            tests = [(domain == e) | F.endswith(domain, F.lit("." + e)) for e in entries]
        else:
            tests = [F.contains(domain, F.lit(e)) for e in entries]
        out = tests[0]
        for test in tests[1:]:
            out = out | test
        return out

    ok = p[_SCHEME].isin("http:", "https:") & _has_host(p) & ~_malformed(p)
    if blocked:
        ok = ok & ~hit(blocked)
    if allowed:
        ok = ok & hit(allowed)
    if check_extension:
        extension = F.substring_index(F.lower(p[_PATH]), ".", -1)
        ok = ok & ~(F.contains(p[_PATH], F.lit(".")) & extension.isin(*SKIP_EXTENSIONS))
    return F.coalesce(ok, F.lit(False))


def is_valid_url(
    url: Column,
    allowed: Sequence[str] = (),
    blocked: Sequence[str] = (),
    check_extension: bool = True,
    match: str = "substring",
) -> Column:
    """http(s), has an authority, not blocked, allowed, not a skipped file type.

    ``match='substring'`` tests list entries anywhere in the authority;
    ``'suffix'`` only whole trailing labels.  Lists given here are short
    configuration; for lists that are tables see ``operators.domains``.
    """
    return let(url_parts(url), lambda p: _valid(p, allowed, blocked, check_extension, match))


def link_targets(
    base: Column,
    hrefs: Column,
    allowed: Sequence[str] = (),
    blocked: Sequence[str] = (),
    check_extension: bool = True,
    match: str = "substring",
) -> Column:
    """Resolved, normalised, valid and distinct targets of raw references, sorted."""

    def target(b: Column, href: Column) -> Column:
        return let(
            let(url_parts(href), lambda h: resolved_parts(b, h)),
            lambda p: F.when(_valid(p, allowed, blocked, check_extension, match), _light(p)),
        )

    trimmed = F.transform(hrefs, lambda h: F.regexp_replace(h, f"^{WS}+|{WS}+$", ""))
    wanted = F.filter(trimmed, lambda h: (h != "") & ~F.startswith(h, F.lit("#")))
    return let(
        url_parts(base),
        lambda b: F.sort_array(
            F.array_distinct(F.filter(F.transform(wanted, lambda h: target(b, h)), lambda u: u.isNotNull()))
        ),
    )


# --- hashes ----------------------------------------------------------------


def storage_hash(url: Column) -> Column:
    """Key of the content table: SHA-256 of the URL as written."""
    return F.sha2(url, 256)


def url_key_hash(url: Column) -> Column:
    """Key for duplicate detection: SHA-256 of the canonical form."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(canonical_url_key(url)), WS + "+", " ")), 256)
