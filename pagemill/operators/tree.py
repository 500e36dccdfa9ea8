"""Reading a page through its element tree, for pages that need one.

A small per-page helper behind one Arrow UDF: Spark decides which pages come
here and does everything before and after.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from pagemill.functions.values import MAIN_SELECTORS, UNWANTED_CLASSES, UNWANTED_TAGS

# --- fixed values: elements without content, and start tags that end an open element ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
    "pre section table ul".split()
)
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
            "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<plain>title|textarea)\b(?P<plain_attrs>[^>]*)>(?P<plain_text>.*?)(?:</(?P=plain)\s*>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s>/]*)[^>]*>"
    r"|<(?P<open>[a-zA-Z][^\s>/]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)


_ENTITY = re.compile(r"&(?:#0*(\d+);?|#[xX]0*([0-9a-fA-F]+);?|([A-Za-z][A-Za-z0-9]*);)")


def _char(match):
    decimal, hexadecimal, name = match.groups()
    if name:
        code = 39 if name == "apos" else name2codepoint.get(name, 0)
    else:
        digits = decimal or hexadecimal
        code = int(digits, 10 if decimal else 16) if len(digits) < 9 else 0
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else match[0]


def _unescape(text):
    """Decode entities; a name counts only with its semicolon."""
    return _ENTITY.sub(_char, text) if "&" in text else text


class _Node:
    __slots__ = ("name", "attrs", "parent", "children")

    def __init__(self, name, attrs, parent):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self):
        """Descendant elements in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, _Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))

    def texts(self):
        stack = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, _Node):
                stack.extend(reversed(item.children))
            else:
                yield item

    def text(self):
        return "".join(self.texts())

    def classes(self):
        return (self.attrs.get("class") or "").split()


def _attrs(source):
    out = {}
    for name, double, single, bare in _ATTR.findall(source):
        out.setdefault(name.lower(), _unescape(double or single or bare))
    return out


def _tree(source):
    root = node = _Node("", {}, None)
    at = 0
    for match in _TOKEN.finditer(source):
        if match.start() > at:
            node.children.append(_unescape(source[at:match.start()]))
        at = match.end()
        if match["plain"]:
            leaf = _Node(match["plain"].lower(), _attrs(match["plain_attrs"]), node)
            leaf.children.append(_unescape(match["plain_text"]))
            node.children.append(leaf)
        elif match["open"]:
            name = match["open"].lower()
            while node.name in ENDED_BY and name in ENDED_BY[node.name]:
                node = node.parent
            child = _Node(name, _attrs(match["attrs"]), node)
            node.children.append(child)
            if name not in VOID and not match["attrs"].endswith("/"):
                node = child
        elif match["close"]:
            name, above = match["close"].lower(), node
            while above is not None and above.name != name:
                above = above.parent
            if above is not None and above.parent is not None:
                node = above.parent
    if at < len(source):
        node.children.append(_unescape(source[at:]))
    return root


def _selected(node, selector):
    if selector[0] == ".":
        return selector[1:] in node.classes()
    if selector[0] == "#":
        return node.attrs.get("id") == selector[1:]
    if selector[0] == "[":
        key, value = selector[1:-1].split("=")
        return node.attrs.get(key) == value.strip('"')
    return node.name == selector


def _main(root, nodes):
    for selector in (*MAIN_SELECTORS, "body"):
        for node in nodes:
            if _selected(node, selector):
                return node
    return root


def _meta(nodes, key, value):
    for node in nodes:
        if node.name == "meta" and node.attrs.get(key) == value:
            return node.attrs.get("content", "")
    return None


def _first(*values):
    return next((v for v in values if v is not None), None)


def read_page(source: str) -> dict:
    """The pieces of one page; reading order matters, see the steps."""
    root = _tree(source)
    nodes = list(root.walk())
    first = {}
    for node in nodes:
        first.setdefault(node.name, node)
    html_attrs = first["html"].attrs if "html" in first else {}
    canonical = next(
        (n for n in nodes if n.name == "link" and "canonical" in (n.attrs.get("rel") or "").split()), None
    )
    page = {
        "title": first["title"].text() if "title" in first else None,
        "meta": {
            "description": _first(_meta(nodes, "name", "description"), _meta(nodes, "property", "og:description")),
            "keywords": _meta(nodes, "name", "keywords"),
            "author": _first(_meta(nodes, "name", "author"), _meta(nodes, "property", "article:author")),
        },
        "language": html_attrs.get("lang") or html_attrs.get("xml:lang"),
        "canonical": canonical.attrs.get("href") if canonical else None,
        "headings": {f"h{i}": [n.text() for n in nodes if n.name == f"h{i}"] for i in range(1, 7)},
    }
    # Choosing the main element removes its navigation; links, images and
    # microdata are read from what is left.
    main = _main(root, nodes)
    for node in list(main.walk()):
        if node.name in UNWANTED_TAGS or set(UNWANTED_CLASSES) & set(node.classes()):
            node.parent.children.remove(node)
    if main is root:
        # Without a <body> tag, head elements are not part of the body.
        kept = _Node("", {}, None)
        kept.children = [c for c in root.children if not (isinstance(c, _Node) and c.name in ("head", "title"))]
        main = kept
    page["content"] = " ".join(t.strip() for t in main.texts() if t.strip())
    left = list(root.walk())
    page["hrefs"] = [n.attrs["href"] for n in left if n.name == "a" and "href" in n.attrs]
    page["srcs"] = [n.attrs["src"] for n in left if n.name == "img" and "src" in n.attrs]
    page["microdata"] = []
    for item in left:
        kind = item.attrs.get("itemtype", "").split("/")[-1]
        props = {}
        for node in item.walk() if kind else ():
            name = node.attrs.get("itemprop")
            value = node.attrs.get("content") or "".join(t.strip() for t in node.texts())
            if name and value:
                props[name] = value
        if props:
            page["microdata"].append({"type": kind, "props": props})
    page["parse_error"] = None
    return page


_strings = ArrayType(StringType())
RAW_TYPE = StructType([
    StructField("title", StringType()),
    StructField("meta", StructType([StructField(n, StringType()) for n in ("description", "keywords", "author")])),
    StructField("language", StringType()),
    StructField("canonical", StringType()),
    StructField("headings", StructType([StructField(f"h{i}", _strings) for i in range(1, 7)])),
    StructField("content", StringType()),
    StructField("hrefs", _strings),
    StructField("srcs", _strings),
    StructField("microdata", ArrayType(StructType([
        StructField("type", StringType()), StructField("props", MapType(StringType(), StringType())),
    ]))),
    StructField("parse_error", StringType()),
])


def _read(source):
    if source is None:
        return {name: None for name in RAW_TYPE.names}
    try:
        return read_page(source)
    except Exception as error:  # one bad page must not fail the job
        return {**{name: None for name in RAW_TYPE.names}, "parse_error": f"{type(error).__name__}: {error}"}


@F.pandas_udf(RAW_TYPE)
def tree_fields(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(source) for source in html], columns=RAW_TYPE.names)
