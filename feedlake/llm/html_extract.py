"""HTML extraction with site template removal.

Every page is cut into tags, text and comments by one regular expression and read into a
light element tree (void elements, implied ends of p, li, td and the like, unclosed tags up
to the end of the page). Then:

1. each element below ``body`` that holds text gets a hash of its whole subtree (tag, class,
   text and children); Spark counts, per host, the distinct pages that hold it (copies of a
   page, by the hash of its html, once, here and in the host's pages). Subtrees on at least
   ``min_pages`` pages and ``min_share`` of the host's pages are the site's template and are
   deleted;
2. elements that never belong to the text (navigation, header and footer of the site,
   asides, forms, scripts, styles, graphics, and elements whose class, id or role names menus,
   sidebars, notices, adverts or comments) are deleted. Names that only say what a layout
   has or lacks (has-sidebar, no-header, with-menu) do not count, nor do names of an element
   that wraps a main element or, if no article stands outside such elements, an article.
   Inside main content, a text block goes only if one of its names is such a word as a whole
   (``notice``, not ``search-engine``), and the headings of a header stay;
3. if the page has main content (article, main, role=main), only that is kept. Paragraphs,
   headings and list items inside it are never taken for a template, so a sentence that many
   articles share stays.

Character references are decoded, white space within a block becomes one blank, blocks are
joined in page order by two line feeds. ``br`` is white space within its block.

Edge cases: null or empty html, or a page without text, gives an empty string; malformed
markup never fails and takes time in proportion to its length (a tag that the next ``<`` or the end of the page
cuts off is markup if it has an attribute, else text); pages with a null or odd url share the empty
host; rows that repeat a page id are handled one by one; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedlake.llm.checked import join_lists
from feedlake.session import materialize

MIN_PAGES = 10
MIN_SHARE = 0.3

#: Attributes: possessive, and no further than the next "<" outside quotes, so that a tag is read once.
_ATTRIBUTES = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|textarea)\b{_ATTRIBUTES}>.*?(?:</\1\s*+>|\Z)"
    rf"|<[!?][^<>]*+(?:>|(?=<)|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)({_ATTRIBUTES})(>?)", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span "
                    "strike strong sub sup time tt u var wbr".split())
_DROPPED = frozenset("head nav header footer aside form button input menu dialog figcaption title".split()) - {"figcaption"}
#: Elements whose content is no text, up to their end tag or their parent's end. They are not part of the tree.
_SKIPPED = frozenset("svg object iframe select noscript template".split())
_MAIN = frozenset(("article", "main"))
_TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th".split())
#: Tags whose start ends an open element of the second list.
_ENDS = {t: ("p",) for t in "p div ul ol dl table section article aside header footer nav main form h1 h2 h3 h4 h5 h6 blockquote pre hr figure".split()}
_ENDS |= {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"),
          "option": ("option",)}
#: An implied end does not reach beyond these.
_SCOPE = frozenset("ul ol dl table div section article aside header footer nav main form body html blockquote td th li".split()) | _SKIPPED
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banners?|sponsor(?:ed|s)?|promos?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side-?bar|"
    r"footers?|headers?|masthead|cookies?|consent|notices?|newsletters?|subscribe|popup|modal|comments?|replies|disqus|respond|share|sharing|social|related|"
    r"widgets?|pagination|pager|toolbar|complementary|contentinfo|search)(?:$|[\s_-])", re.I)
#: The same word as a whole name, which counts for a text block of the main content, too.
_NOISE_NAME = re.compile(r"(?:^|\s)" + _NOISE.pattern.removeprefix(r"(?:^|[\s_-])").removesuffix(r"(?:$|[\s_-])") + r"(?:$|\s)", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a name says of the layout around an element, not of the element.
_LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|with)[_-]\S*", re.I)


class Element:
    #: noise: by its kind; named: by class, id or role; exact: by a whole name; main: article, main or role=main.
    __slots__ = ("tag", "noise", "named", "exact", "main", "mark", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children = tag, []
        self.noise, self.named, self.exact, self.main, self.mark = tag in _DROPPED, False, False, tag in _MAIN, tag
        if attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                value = "".join(values)
                self.mark += f" {name.lower()}={value}"
                if value and tag not in ("body", "html", "article", "main") and _NOISE.search(value) and _NOISE.search(_LAYOUT.sub("", value)):
                    self.named = True
                    self.exact = self.exact or bool(_NOISE_NAME.search(value))
                if name.lower() == "role" and value.strip().lower() == "main":
                    self.main = True
            self.named = self.named and not self.main


def parse(text: str) -> Element:
    root = Element("html")
    stack, at = [root], 0
    opened: Counter[str] = Counter()                 # open elements by tag, so that no search is in vain

    def close(i: int) -> None:
        opened.subtract(e.tag for e in stack[i:])
        del stack[i:]

    for m in _TOKEN.finditer(text):
        if m.start() > at:
            stack[-1].children.append(text[at:m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        if not m[5] and "=" not in m[4] and not m[2]:            # a "<" of the text
            stack[-1].children.append(m[0])
            continue
        tag = tag.lower()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in ("html", "body"):
            continue
        ended = _ENDS.get(tag)
        if ended and any(opened[t] > 0 for t in ended):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    close(i)
                    break
                if stack[i].tag in _SCOPE:
                    break
        element = Element(tag, m[4])
        if tag not in _SKIPPED:
            stack[-1].children.append(element)
        if tag not in _VOID and not m[4].endswith("/"):
            stack.append(element)
            opened[tag] += 1
    if at < len(text):
        stack[-1].children.append(text[at:])
    return root


def _post_order(root: Element) -> list[Element]:
    """Children before parents, without recursion."""
    out, stack = [], [root]
    while stack:
        e = stack.pop()
        out.append(e)
        stack.extend(c for c in e.children if not isinstance(c, str))
    return out[::-1]


def subtree_hashes(root: Element) -> dict[int, int]:
    """Hash of each element that holds text, by the element's identity."""
    out: dict[int, int] = {}
    for e in _post_order(root):
        digest, any_text = blake2b(e.mark.encode("utf-8", "replace"), digest_size=8), False
        for c in e.children:
            if isinstance(c, str):
                if words := " ".join(c.split()):
                    any_text = True
                    digest.update(b"\0t" + words.encode("utf-8", "replace"))
            elif (h := out.get(id(c))) is not None:
                any_text = True
                digest.update(b"\0e" + h.to_bytes(8, "little", signed=True))
        if any_text:
            out[id(e)] = int.from_bytes(digest.digest(), "little", signed=True)
    return out


def _keep_wrappers(root: Element) -> None:
    """Elements that wrap main content are not noise by their name."""
    def wrappers(is_content) -> tuple[list[Element], bool]:
        """Named elements around such content, and whether some of it stands outside of them."""
        found: list[Element] = []
        free, stack = False, [(root, ())]
        while stack:
            e, around = stack.pop()
            if e.noise:
                continue
            if is_content(e):
                found += around
                free = free or not around
            if e.named:
                around = (*around, e)
            stack.extend((c, around) for c in e.children if not isinstance(c, str))
        return found, free

    for e in wrappers(lambda e: e.main and e.tag != "article")[0]:
        e.named = False
    # with an article outside, those inside named elements are comments or teasers
    found, free = wrappers(lambda e: e.tag == "article")
    if not free:
        for e in found:
            e.named = False


def _main_parts(root: Element) -> list[Element]:
    """Outermost main elements outside deleted ones."""
    found, stack = [], [root]
    while stack:
        e = stack.pop()
        if e.noise or e.named:
            continue
        if e.main:
            found.append(e)
            continue
        stack.extend(c for c in reversed(e.children) if not isinstance(c, str))
    return found


def _outermost(root: Element, tags: frozenset[str]) -> list[Element]:
    """Descendants with one of the tags, outside of each other and of deleted elements, in page order."""
    found, stack = [], [root]
    while stack:
        e = stack.pop()
        if e.tag in tags:
            found.append(e)
        elif e is root or not (e.noise or e.named):
            stack.extend(c for c in reversed(e.children) if not isinstance(c, str))
    return found


def extract(text: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """Main text of a page; ``template``: subtree hashes to delete."""
    root = parse(text)
    hashes = subtree_hashes(root) if template else {}
    _keep_wrappers(root)
    parts = _main_parts(root)
    if any(p.tag == "main" or p.tag not in _MAIN for p in parts):        # articles inside a main element come with it
        parts = [p for p in parts if p.tag != "article"] or parts
    blocks: list[str] = []
    for part in parts or [root]:
        run: list[str] = []

        def flush(run=run):
            words = entities.unescape("".join(run)).split()
            if words:
                blocks.append(" ".join(words))
            run.clear()

        todo: list = [part]
        while todo:
            e = todo.pop()
            if e is None:
                flush()
            elif isinstance(e, str):
                run.append(e)
            elif e.tag == "br":
                run.append(" ")
            elif e.tag == "header" and parts and not e.named:    # of an article: its headings
                todo += reversed([h for h in _outermost(e, _HEADINGS)])
            elif not (e.noise or (e.exact if parts and e.tag in _TEXT_BLOCKS else e.named)
                      or (hashes and hashes.get(id(e)) in template and not (parts and (e is part or e.tag in _TEXT_BLOCKS or e.tag in _INLINE)))):
                if e.tag not in _INLINE:
                    flush()
                    todo.append(None)
                todo.extend(reversed(e.children))
        flush()
    return "\n\n".join(blocks)


def host_of(url):
    """Column: lower-case host of a url without port, user or leading www; empty if there is none."""
    host = F.regexp_extract(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def template_subtrees(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, subtrees (array of hashes) of every host that has a template.

    At most 1 / min_share hashes per average element of a page remain for a host."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[str, int]] = set()           # saves parsing copies; those it forgets go in distinct()
        for batch in batches:
            hosts, hashes, found = [], [], []
            if len(done) > 200_000:
                done.clear()
            for host, page, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (host, page) in done:
                    continue
                done.add((host, page))
                hosts.append(host)
                hashes.append(page)
                found.append(sorted(set(subtree_hashes(parse(text or "")).values())))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                                             names=["host", "page", "subtrees"])

    page = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html")
    hosts = page.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    # copies have equal lists: one row each is left before the lists are taken apart
    distinct = page.mapInArrow(run, "host string, page long, subtrees array<long>").distinct()
    seen = (distinct.select("host", F.explode("subtrees").alias("subtree"))
            .groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages))
    return (seen.join(hosts, "host").where(F.col("n") >= F.col("pages") * min_share)
            .groupBy("host").agg(F.sort_array(F.collect_set("subtree")).alias("subtrees")))


def extract_main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    templates = materialize(template_subtrees(pages, min_pages, min_share), "site-templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[tuple, frozenset[int]] = ((), frozenset())
        for batch in batches:
            out = []
            for text, subtrees in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                key = tuple(subtrees or ())
                if key != kept[0]:
                    kept = (key, frozenset(key))
                out.append(extract(text or "", kept[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(np.array([len(x) for x in out], np.int64))],
                                             names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = join_lists(rows, templates, "host", "subtrees").select("page_id", "url", "html", "subtrees")
    kind = lambda c: pages.schema[c].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind('page_id')}, url {kind('url')}, text string, n_chars long")
