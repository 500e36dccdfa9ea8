"""HTML columns: what regular expressions can read from a page, row by row.

``raw_fields`` gives the pieces of a page as text; ``operators.extract``
cleans and resolves them.  ``needs_tree`` tells for which pages these
expressions would not be exact; those go through ``operators.tree``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.urls import let
from pagemill.functions.values import ENTITIES, UNWANTED_CLASSES, UNWANTED_TAGS

# Patterns begin with '<', so the search skips plain text quickly.
_NOT_CONTENT = r"(?is)<(?:!--.*?(?:-->|\z)|(script|style|noscript)\b[^>]*>.*?(?:</\1\s*>|\z))"
_TAG = r"<(?:/?[A-Za-z]|[!?])[^>]*>"
_CUT_MARK = "<!>"  # stands where something was cut out: reads as a tag, not as text
HEADINGS = tuple(f"h{level}" for level in range(1, 7))


def strip_boilerplate(html: Column) -> Column:
    """Without scripts, styles, noscript parts and comments."""
    return F.regexp_replace(html, _NOT_CONTENT, _CUT_MARK)


def decode_entities(text: Column) -> Column:
    """The fixed entity list, '&amp;' last; other entities make a page ``needs_tree``."""

    def decoded(t: Column) -> Column:
        out = t
        for entity, char in ENTITIES.items():
            out = F.replace(out, F.lit(entity), F.lit(char))
        return F.when(F.contains(t, F.lit("&")), F.replace(out, F.lit("&amp;"), F.lit("&"))).otherwise(t)

    return let(text, decoded)


def inner_text(fragment: Column, separator: str = "") -> Column:
    """Text of a fragment; ``separator`` goes between its text nodes."""
    return decode_entities(F.regexp_replace(fragment, _TAG, separator))


# An attribute of a start tag, and what may stand before one.  Possessive: a tag is read once, from left to right.
_ATTRIBUTE = r"[^\s=\"'/>]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+"
_BEFORE = r"[\s/\"'=]*+"


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag, read in order, so that no value is taken for a name; null if the tag does not have it.

    Of several attributes of a name the first counts.
    """
    ends = r"(?=[\s/>=\"'])"
    up_to = rf"(?is)^<[a-z][^\s>/]*+(?:{_BEFORE}(?!{name}{ends}){_ATTRIBUTE})*+{_BEFORE}{name}{ends}"
    value = r"\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
    # The plain test spares most tags both searches.
    return F.when(
        F.contains(F.lower(tag), F.lit(name)),
        let(
            F.regexp_extract(tag, up_to + value, 1),
            lambda quoted: F.when(quoted != "", decode_entities(_unquoted(quoted))).otherwise(F.when(tag.rlike(up_to), F.lit(""))),
        ),
    )


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"(?s)^([\"'])(.*)\1$", "$2")


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def main_element(stripped: Column) -> Column:
    """The first <main> or <article> with its tags; '' if there is none that is closed."""
    return F.regexp_extract(stripped, r"(?is)<(main|article)(?:\s[^>]*)?>.*?</\1\s*>", 0)


def main_inner(element: Column) -> Column:
    """Inside of an element: what lies between its first '>' and its last '<'."""
    head, tail = F.instr(element, ">"), F.length(F.substring_index(element, "<", -1)) + 1
    return F.substr(element, head + 1, F.length(element) - head - tail)


# Mark-up that only a tree reads right, in one pass: an entity that is not of
# the fixed list, without its semicolon being plain text; angle brackets in
# quotes; elements whose content is text, or microdata; mark-up within a title,
# which is text; headings that are not closed, or hold others.
_KNOWN = "|".join(e[1:-1] for e in ENTITIES) + "|amp"
_ODD = (
    rf"(?is)&(?:#|(?!(?:{_KNOWN});)[a-z][a-z0-9]*+;)"
    r"""|=\s*+(?:"[^"<>]*+[<>]|'[^'<>]*+[<>])"""
    r"|<(?:svg|textarea|template|iframe|xmp|plaintext|[a-z][^<>]*itemtype"
    r"|title(?:\s[^>]*+)?>[^<]*+(?:<(?!/title\s*>)|\z)"
    r"|(h[1-6])(?:\s[^>]*+)?>(?:[^<]|<(?!/\1\s*>|h[1-6][\s>]))*+(?:<h[1-6][\s>]|\z)"
)
# Beside an article, a main element that comes later or is not closed counts.
_ODD_BESIDE_ARTICLE = rf"{_ODD}|main[\s>])"
_ODD_BESIDE_MAIN = rf"{_ODD})"
_ODD_INSIDE = rf"(?is)<(?:{'|'.join((*UNWANTED_TAGS, 'main', 'article'))})|\bclass\s*+=[^>]*(?:{'|'.join(UNWANTED_CLASSES)})"


def needs_tree(stripped: Column, element: Column) -> Column:
    """True where a tree is needed: ``raw_fields`` is exact for all other pages.  ``element`` is :func:`main_element`."""
    is_main = F.lower(F.substr(element, F.lit(1), F.lit(5))) == "<main"
    inner = main_inner(element)
    beside = F.when(is_main, stripped.rlike(_ODD_BESIDE_MAIN)).otherwise(stripped.rlike(_ODD_BESIDE_ARTICLE))
    return F.coalesce((element == "") | (inner == "") | beside | inner.rlike(_ODD_INSIDE), F.lit(False))


def _headings(stripped: Column) -> Column:
    return _all(stripped, r"(?is)<(h[1-6])(?:\s[^>]*)?>.*?</\1\s*>", 0)


def _named(tags: Column, name: str) -> Column:
    return F.filter(tags, lambda t: F.lower(F.substr(t, F.lit(2), F.lit(len(name)))) == name)


def _meta(tags: Column, attribute_name: str, value: str) -> Column:
    """``content`` of the first matching meta tag: '' if it has none, null without such a tag."""
    return let(
        F.get(F.filter(tags, lambda t: attribute(t, attribute_name) == value), F.lit(0)),
        lambda t: F.when(t.isNotNull(), F.coalesce(attribute(t, "content"), F.lit(""))),
    )


def _references(tags: Column, tag: str, name: str) -> Column:
    found = F.transform(_named(tags, tag), lambda t: attribute(t, name))
    return F.filter(found, lambda v: v.isNotNull())


def start_tags(stripped: Column) -> Column:
    """All start tags of interest in one pass; 'a' is told from longer names by its white space, made a plain space here."""
    return F.transform(_all(stripped, r"(?is)<(?:html|meta|link|a|img)\s[^>]*>", 0), lambda t: F.regexp_replace(t, r"^(<[aA])\s", "$1 "))


def raw_fields(stripped: Column, main: Column, tags: Column) -> dict[str, Column]:
    """The page's pieces before cleaning, each a column of its own, so that those not asked for are not computed."""
    title = F.regexp_extract(stripped, r"(?is)<title(?:\s[^>]*)?>.*?</title\s*>", 0)

    def lang(t: Column) -> Column:
        return F.coalesce(F.nullif(attribute(t, "lang"), F.lit("")), attribute(t, "xml:lang"))

    def canonical(t: Column) -> Column:
        rel = F.split(F.coalesce(attribute(t, "rel"), F.lit("")), r"\s+")
        return F.array_contains(rel, "canonical")

    def of_level(h: Column, level: str) -> Column:
        return F.transform(_named(h, level), lambda x: inner_text(x)).alias(level)

    metas = _named(tags, "meta")
    return {
        "title": let(title, lambda x: F.when(x != "", inner_text(x))),
        "description": let(metas, lambda m: F.coalesce(_meta(m, "name", "description"), _meta(m, "property", "og:description"))),
        "keywords": let(metas, lambda m: _meta(m, "name", "keywords")),
        "author": let(metas, lambda m: F.coalesce(_meta(m, "name", "author"), _meta(m, "property", "article:author"))),
        "language": let(F.get(_named(tags, "html"), F.lit(0)), lang),
        "canonical": let(
            F.get(F.filter(_named(tags, "link"), canonical), F.lit(0)),
            lambda x: F.when(x.isNotNull(), attribute(x, "href")),
        ),
        "headings": let(_headings(stripped), lambda h: F.struct(*[of_level(h, level) for level in HEADINGS])),
        "content": inner_text(main, " "),
        "hrefs": _references(tags, "a ", "href"),
        "srcs": _references(tags, "img", "src"),
        # Filled by the tree only: pages with microdata go there.
        "microdata": F.array().cast("array<struct<type:string,props:map<string,string>>>"),
        "parse_error": F.lit(None).cast("string"),
    }


def json_ld(html: Column) -> Column:
    """Array of (type, json) per object in the page's ld+json blocks.

    Read from the raw page, before scripts go.  Blocks that are not JSON are
    skipped; of a list-valued type the first entry counts.
    """
    # Comments go, but not what looks like one inside a script.
    seen = F.regexp_replace(html, r"(?is)(<script\b[^>]*+>.*?</script\s*+>)|<!--.*?(?:-->|\z)", "$1")
    blocks = _all(
        seen,
        r"(?is)<script\s(?:[^>]*?[\s\"'])?type\s*=\s*[\"']?application/ld\+json[\"']?(?:\s[^>]*)?>(.*?)</script\s*>",
        1,
    )

    def is_object(v: Column) -> Column:
        return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))

    def items(v: Column) -> Column:
        return F.when(is_object(v), F.array(v)).otherwise(
            F.filter(F.try_variant_get(v, "$", "array<variant>"), is_object)
        )

    def typed(v: Column) -> Column:
        first = F.try_variant_get(v, "$['@type'][0]", "string")
        return F.struct(
            F.coalesce(first, F.try_variant_get(v, "$['@type']", "string"), F.lit("Unknown")).alias("type"),
            F.to_json(v).alias("json"),
        )

    parsed = F.filter(F.transform(blocks, lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())
    objects = F.filter(F.flatten(F.filter(F.transform(parsed, items), lambda a: a.isNotNull())), lambda v: v.isNotNull())
    empty = F.array().cast("array<struct<type:string,json:string>>")
    # The plain substring test spares most pages the block search.
    return F.when(F.contains(html, F.lit("ld+json")), F.transform(objects, typed)).otherwise(empty)
