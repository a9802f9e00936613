"""HTML as column expressions: entities, links, whole elements.

Everything stays in the JVM: a text is cut once with a regex into an array of
pieces, and higher-order functions work on the pieces, so the cost is linear
in the text's length and nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space around a text node (Unicode's White_Space of the basic plane).
SPACE = "".join(chr(i) for i in range(0x10000) if chr(i).isspace())

_REFERENCE = r"&(?:#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,7}|[A-Za-z][0-9A-Za-z]{1,31});|[^&]+|&"
_TAG = r"<[A-Za-z/!?][^<>]*>"


def _named() -> Column:
    """The standard's entity names (with ``;``) and what they stand for, from Python's own table."""
    return F.from_json(F.lit(json.dumps({f"&{k}": v for k, v in html5.items() if k.endswith(";")})),
                       "map<string,string>")


def _windows() -> Column:
    """Numbers 128 to 159 stand for their Windows-1252 characters, as browsers read them."""
    return F.from_json(F.lit(json.dumps({str(i): bytes([i]).decode("cp1252", "replace") for i in range(128, 160)})),
                       "map<string,string>")


def _code_point(n: Column) -> Column:
    bad = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    safe = F.when(bad, F.lit(0xFFFD)).otherwise(n)
    char = F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
    return F.when(n.between(128, 159), F.try_element_at(_windows(), n.cast("string"))).otherwise(char)


def decode_references(c: Column) -> Column:
    """Named and numeric character references, decoded in one pass (``&amp;lt;`` stays ``&lt;``).

    Unknown names stay as written; numbers that are no character become U+FFFD. NULL gives NULL.
    """
    def char(x: Column) -> Column:
        number = F.substring(x, 3, 9)
        return (F.when(x.rlike("^&#[xX]"), _code_point(F.conv(F.rtrim(F.substring(x, 4, 9), F.lit(";")), 16, 10).cast("long")))
                .when(x.startswith("&#"), _code_point(F.rtrim(number, F.lit(";")).try_cast("long")))
                .when((x == "&amp;") | (x == "&"), F.lit("&"))       # by far the most frequent ones
                .when(x.startswith("&"), F.coalesce(F.try_element_at(_named(), x), x))
                .otherwise(x))

    pieces = F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0))
    return F.when(c.contains("&"), F.array_join(F.transform(pieces, char), "")).otherwise(c)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without_code(c: Column) -> Column:
    """No scripts, styles and comments; one that is never closed runs to the end, as in a browser."""
    for tag in ("script", "style"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b.*?(?:</{tag}\s*>|\z)", "")
    return F.regexp_replace(c, r"(?s)<!--.*?(?:-->|\z)", "")


_LINK = (r"""(?is)^<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a\s*>""")
_BLOCK = "p|div|h[1-6]|li|ul|ol|article|section|nav|br|tr|table|header|footer|main|body|html|blockquote|pre"


def html_to_text(html: Column) -> Column:
    """HTML to plain text with links kept as ``[text](href)`` and images dropped.

    Scripts, styles, head and comments go, links are written out whatever the
    quoting of their address, block elements become line breaks, other tags
    vanish, character references are decoded once and blank runs collapse.
    A ``<`` that starts no tag, or one that is not closed before the next
    ``<``, is text. NULL gives NULL.
    """
    c = F.regexp_replace(_without_code(html), r"(?is)\A(?>(.*?)<head\b).*?</head\s*>", "$1")
    c = F.regexp_replace(c, r"(?i)<img\b[^<>]*>", "")
    links = F.transform(F.split(c, r"(?i)(?=<a\s)"), lambda p: F.regexp_replace(p, _LINK, r"[$4]($1$2$3)"))
    c = F.array_join(links, "")
    c = F.regexp_replace(c, rf"(?i)</?(?:{_BLOCK})\b[^<>]*>", "\n")
    c = _let(F.regexp_replace(c, _TAG, ""), decode_references)
    c = F.regexp_replace(c, r"[ \u00a0\t\r\f]+", " ")
    c = F.regexp_replace(c, r" ?\n[ \n]*", "\n")
    return F.trim(F.regexp_replace(c, r"^\n+|\n+$", ""))


def node_text(fragment: Column) -> Column:
    """Text nodes of an HTML fragment without scripts (``element``), each decoded and stripped, joined without a separator."""
    nodes = F.split(fragment, _TAG)
    return F.array_join(F.transform(nodes, lambda x: F.btrim(decode_references(x), F.lit(SPACE))), "")


def element(html: Column, tag: str, classes: Sequence[str] = ()) -> Column:
    """Inner HTML of the first ``tag`` element that has one of ``classes`` (any, if none is given).

    The page is cut before each opening and closing ``tag``; from the first
    match on, a fold counts the open ones, so nested elements of the same
    name belong to the match. An element that is never closed runs to the end.
    NULL when there is none.
    """
    one = "|".join(classes)
    has = (rf"""\sclass\s*=\s*(?:"(?:[^"]*\s)?(?:{one})(?:\s[^"]*)?"|'(?:[^']*\s)?(?:{one})(?:\s[^']*)?'|(?:{one})(?=[\s>/]))"""
           if classes else "")
    opening = rf"(?is)^<{tag}(?:\s[^>]*)?>" if not classes else rf"(?is)^<{tag}(?=\s)[^>]*?{has}[^>]*>"
    pieces = F.split(_without_code(html), rf"(?i)(?=</?{tag}[\s>])")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("depth"))

    def mark(p: Column) -> Column:
        return (F.when(p.rlike(opening), 2).when(p.rlike(rf"(?i)^<{tag}[\s>]"), 1)
                .when(p.rlike(rf"(?i)^</{tag}[\s>]"), -1).otherwise(0))

    def step(s: Column, m: Column) -> Column:
        at = s["at"] + 1
        inside = (s["start"] > 0) & (s["end"] == 0)
        begins = (s["start"] == 0) & (m == 2)
        depth = F.when(begins, 1).when(inside, s["depth"] + F.signum(m).cast("int")).otherwise(0)
        return F.struct(at.alias("at"), F.when(begins, at).otherwise(s["start"]).alias("start"),
                        F.when(inside & (depth == 0), at).otherwise(s["end"]).alias("end"), depth.alias("depth"))

    def cut(ps: Column, f: Column) -> Column:
        size = F.when(f["end"] > 0, f["end"] - f["start"]).otherwise(F.size(ps))
        return F.when(f["start"] > 0, F.array_join(F.slice(ps, f["start"], size), ""))

    inner = _let(pieces, lambda ps: _let(F.aggregate(F.transform(ps, mark), zero, step), lambda f: cut(ps, f)))
    return F.regexp_replace(inner, r"(?s)^<[^>]*>", "")
