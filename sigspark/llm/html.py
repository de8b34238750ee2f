"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to the elements around them, less with each level; an element's
points are discounted by the share of its text inside links. The element of most points, or the article it belongs to,
is kept with those siblings that read like it. What is no part of any article - menus, page headers and footers,
sidebars, notices, adverts, forms, scripts, styles, comments of readers - is left out beforehand by tag and by name.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.tables import in_batches

_MARKUP = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S,
)
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Elements that are never part of an article.
_OUTSIDE = frozenset(
    "nav footer aside form script style noscript template iframe object embed button select option textarea input "
    "datalist dialog menu svg math canvas audio video map head title xmp noembed noframes fieldset".split()
)
#: Words in a class, id or role that tell the same. Fixed values.
_OUTSIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|breadcrumbs?|cookies?|consent|"
    r"gdpr|notice|notices|alert|comments?|commentlist|respond|replies|disqus|footer|foot|topbar|navbar|"
    r"nav|navigation|menu|menubar|sidebar|side|rail|widget\w*|related|recommend\w*|more-stories|share|sharing|social|"
    r"subscribe|subscription|newsletter|signup|sign-up|login|popup|modal|overlay|paywall|pagination|pager|search|skip-link|"
    r"toolbar|tags|taglist|complementary|contentinfo|dialog)(?=$|[\s_-])",
    re.I,
)
_HEADER_NAME = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.I)
_ARTICLE_NAME = re.compile(r"(?:^|[\s_-])(?:article|articlebody|entry|main|post|story|content|body)(?=$|[\s_-])", re.I)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|$|/)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
#: Open elements that a start tag ends.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr", "td", "th"}, {"table"}),
}


class _Node:
    __slots__ = ("tag", "parent", "outside", "names", "score", "chars", "linked", "kept")

    def __init__(self, tag, parent, outside, names):
        self.tag, self.parent, self.outside, self.names = tag, parent, outside, names
        self.score, self.chars, self.linked, self.kept = 0.0, 0, 0, None


def _outside(tag: str, rest: str, names: str, inside_article: bool) -> bool:
    if tag in _OUTSIDE or rest and _HIDDEN.search(rest):
        return True
    if (tag == "header" or names and tag not in ("html", "body") and _HEADER_NAME.search(names)) and not inside_article:
        return True
    if tag in ("html", "body", "article", "main") and not re.search(r"comment", names, re.I):
        return False
    return bool(names) and bool(_OUTSIDE_NAME.search(names))


def _blocks(page: str):
    """``(element, text, characters in links)`` of each block of text that may belong to an article, in page order."""
    root = _Node("#", None, False, "")
    stack, out, pieces, linked, link = [root], [], [], 0, 0
    at = 0

    def flush():
        nonlocal linked
        if pieces:
            node = stack[-1]
            while node.tag in _INLINE:
                node = node.parent
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append((node, text, min(linked, len(text))))
            pieces.clear()
            linked = 0

    def text(part: str):
        nonlocal linked
        if part and not stack[-1].outside:
            pieces.append(part)
            if link:
                linked += len(part)

    def close(to: int):
        """Leave the elements from ``stack[to]`` on."""
        nonlocal link
        if any(n.tag not in _INLINE for n in stack[to:]):
            flush()
        link -= sum(n.tag == "a" for n in stack[to:])
        del stack[to:]

    while m := _MARKUP.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ends, rest = tag.lower(), m[1] if m[2] else m[4], (m[3] if m[2] else m[6]) or ""
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "article", "table") and tag in _INLINE | {"p", "li"}:
                    break
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(rest)) if "=" in rest else ""
        if tag not in _INLINE:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in _INLINE:
                    break
            if tag in _ENDS:
                ended, within = _ENDS[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in within:
                        break
                    if stack[i].tag in ended:
                        close(i)
                        if tag != "tr":
                            break
                        continue
        inside = any(n.tag in ("article", "main") or n.tag != "body" and n.names and _ARTICLE_NAME.search(n.names)
                     for n in stack)
        if tag in ("article", "main") and stack[-1].outside and not _OUTSIDE_NAME.search(names):
            # an article ends a menu, header or advert that was left open
            first = next(i for i, n in enumerate(stack) if n.outside)
            if not re.search(r"comment|repl|respond|related|recommend|sidebar", stack[first].names, re.I) and stack[first].tag != "aside":
                close(first)
        outside = stack[-1].outside or _outside(tag, rest, names, inside)
        if tag == "a":
            link += 1
        node = _Node(tag, stack[-1], outside, names)
        if not rest.rstrip().endswith("/") or tag not in ("svg", "path"):
            stack.append(node)
    text(page[at:])
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, joined by an empty line; empty if the page has no text."""
    if not page:
        return ""
    blocks = _blocks(page)
    if not blocks:
        return ""
    scored: dict[int, _Node] = {}
    for node, text, linked in blocks:
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "th", "dt"):
            points = 0
        points *= 1 - linked / len(text)
        up, level = node, 0
        while up is not None:
            up.chars += len(text)
            up.linked += linked
            if level:
                up.score += points / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
            elif node.tag not in ("p", "td", "li", "pre", "blockquote", "dd"):
                up.score += points
            scored[id(up)] = up
            up, level = up.parent, level + 1
    for node in scored.values():
        if node.tag in ("article", "main"):
            node.score += 25
        elif node.names and _ARTICLE_NAME.search(node.names):
            node.score += 10
        node.score *= 1 - node.linked / node.chars
    best = max((n for n in scored.values()), key=lambda n: n.score)
    up = best
    while up is not None:
        if up.tag in ("article", "main") or up.names and re.search(r"articlebody", up.names, re.I):
            best = up
            break
        up = up.parent
    for node in scored.values():
        near = node.parent is best.parent and node is not best and node.tag != "#"
        if near:
            dense = node.linked / node.chars
            alike = 0.2 if node.names and node.names == best.names else 0
            near = (node.score + alike * best.score >= max(10, 0.2 * best.score) and dense < 0.5
                    if node.tag not in ("p", "h1", "h2") else dense < 0.25 and (node.chars > 80 or node.tag != "p"))
        node.kept = node is best or near
    lists: dict[int, list[float]] = {}
    for node, text, linked in blocks:
        if node.tag == "li":
            lists.setdefault(id(node.parent), []).append(linked / len(text))
    out = []
    for node, text, linked in blocks:
        # a list of links only is a menu even without a name
        if node.tag == "li" and len(own := lists[id(node.parent)]) > 2 and min(own) > 0.9:
            continue
        up = node
        while up is not None and not up.kept:
            up = up.parent
        if up is not None:
            out.append(text)
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages``: the main text of the whole html.

    A null or empty html, and one without an article's text, gives the empty text. Rows that repeat or lack a page_id
    or url are rows like any other; other columns are not read. Pages are not shuffled.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts,
                   "n_chars": [len(t) for t in texts]}

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))
    return in_batches(source, run, "page_id long, url string, text string, n_chars long")
