"""Main text of web pages by scoring the tree.

The page is parsed into a tree of elements.  Elements and roles that are never part of an
article (menus, footers, asides, forms, scripts) go by what they are.  Words of class and
id decide nothing alone: they make a block lean towards the article or away from it, and
weigh its points.  Each paragraph earns points for its length and its commas and passes
them to its ancestors, less with every level and with every block on the way that leans
away; an element's points are discounted by the share of its text that is in links.  The
container with the most points is kept, with those blocks beside it, or beside what it is
in, that read like it; inside, blocks that lean away go unless they hold most of the points.
A page's only article element, or else its only main element, is where the container is looked for.

Readers' comments may be longer than the article, so they go before points are given: blocks
named so, what follows a heading that says so, and runs of like blocks behind other text, each with
an author or a time of its own.  A form goes too, unless it is wrapped around the article.
"""

from __future__ import annotations

import html
import re
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, quoted

#: Elements whose content is no markup, up to their end tag.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "noembed", "noframes", "xmp", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that stand on a line of their own.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: An open element (left) that the start of one of the others (right) ends.
ENDED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option"},
    "head": {"body"},
}
PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd"}
CONTAINERS = {"div", "section", "article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4"}
#: Blocks that are no containers.
NO_BOX = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "td", "tr", "tbody"}
DROPPED = {"nav", "aside", "footer", "form", "button", "select", "option", "input", "dialog", "menu", "fieldset", "svg", "math", "canvas", "audio", "video", "object", "map", "search", "head", *RAW} - {"form"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: Words of class and id, whole between signs and changes of case, that make a block lean away from the article.
AWAY = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion breadcrumb breadcrumbs nav navbar navigation menu "
    "sidebar sidebars aside footer masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments disqus respond replies pagination pager toolbar widget widgets skip "
    "copyright legal disclaimer outbrain taboola".split()
)
#: Words that make it lean towards the article; both together balance.
TOWARDS = {"article", "content", "main", "post", "entry", "story", "body", "text"}
#: What a block's points are multiplied by if it leans away, or towards; and if it is an article or the main element.
AWAY_FACTOR, TOWARDS_FACTOR, ARTICLE_FACTOR = 0.1, 1.25, 1.5
#: Levels that a paragraph's points reach.
LEVELS = 6
#: Least share of the best container's points for an article around it, for a block beside it, and inside it for one that leans away.
AROUND, BESIDE, INSIDE = 0.3, 0.2, 0.5
LEAST_POINTS = 10.0
#: Words of class and id that name readers' comments, in the languages of the pages, and those that with them say something else.
COMMENTS = set("comment comments commenter commentlist commentthread disqus respond replies kommentar kommentare leserkommentare commentaire commentaires comentario comentarios".split())
NOT_COMMENTS = {"open", "closed", "enabled", "disabled"}
#: Words of class that name who wrote a block, or when.
SIGNED = set("author user username nickname avatar byline commenter date time timestamp datetime posted ago".split())
_SIGNATURE = re.compile(
    r"\b\d{1,2}:\d\d\b|\b\d{4}-\d\d-\d\d\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b(?:\d+|an?) (?:second|minute|hour|day|week|month|year)s? ago\b|\b(?:vor|hace|il y a) (?:\d+|einem|einer|una?|une) |^\W*(?:reply|antworten|répondre|responder)\W*$", re.I
)
_SAYS_COMMENTS = re.compile(r"^\W*(?:\d+ )?(?:(?:reader|readers'|user|your|leave a|post a|add a|latest|recent) )?(?:comments?|kommentare?|leserkommentare|commentaires?|comentarios?)\W*(?:\d+\W*)?$", re.I)
#: Letters of a block that signs another, at most; like blocks in a run, and letters of a form that is wrapped around an article, at least.
SIGNATURE_CHARS, RUN, FORM_CHARS = 60, 3, 140

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?=[\s/]|$))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}


class _Node:
    __slots__ = ("tag", "up", "kids", "gone", "lean", "names", "points", "chars", "linked")

    def __init__(self, tag: str, up: _Node | None, gone: bool, lean: int, names: frozenset[str] = frozenset()):
        self.tag, self.up, self.gone, self.lean, self.names = tag, up, gone, lean, names
        self.kids: list[_Node | str] = []
        self.points = self.chars = self.linked = 0.0


def _attributes(tag: str, attrs: str) -> tuple[bool, int, frozenset[str]]:
    """Whether the element is never part of an article by role or hidden, how it leans by its name (1, 0 or -1), and the name's words."""
    own = tag in ("article", "main")
    if not attrs.strip() or not ("=" in attrs or "hidden" in attrs):
        return False, int(own), frozenset()
    names, gone = set(), False
    for key, a, b, c in _NAMED.findall(attrs):
        key, value = key.lower(), a or b or c
        if key == "role":
            gone |= value.strip().lower() in DROPPED_ROLES
            own |= value.strip().lower() in ("main", "article")
        elif key == "hidden":
            gone |= value.lower() != "until-found"
        elif key == "aria-hidden":
            gone |= value.lower() == "true"
        else:
            names |= {w.lower() for w in _PARTS.findall(value)}
    return gone, max(-1, min(1, int(own or bool(names & TOWARDS)) - int(bool(names & AWAY)))), frozenset(names)


def parse(page: str) -> tuple[_Node, list[_Node]]:
    """The root and all nodes in page order; broken markup is taken as browsers take it, roughly."""
    root = _Node("html", None, False, 0)
    nodes, at, here = [root], 0, root
    n = len(page)
    find = _TOKEN.search
    while at < n:
        m = find(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            here.kids.append(text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            # An end tag of a phrase doesn't reach beyond the block it is in.
            x = here
            while x is not None and x.tag != tag:
                x = None if tag not in BLOCK and x.tag in BLOCK else x.up
            if x is not None and x.up is not None:
                here = x.up
            continue
        if tag in ("html", "body") and any(k.tag == tag and k.up is not None for k in nodes[:8]):
            continue
        if tag in BLOCK:
            x = here
            while x.tag not in BLOCK and x.up is not None:
                x = x.up
            if x.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and x.up is not None:
                here = x.up
            ends = here
            while ends is not None and ends.tag not in ("ul", "ol", "dl", "table", "select", "body", "article", "section", "main", "div", "html"):
                if tag in ENDED_BY.get(ends.tag, ()) and ends.up is not None:
                    here = ends.up
                ends = ends.up
        gone, lean, names = _attributes(tag, m[3])
        inside = here.gone
        if tag == "header":
            # The header of an article holds its title; a page's header goes.
            x = here
            while x is not None and x.tag not in ("article", "main"):
                x = x.up
            gone |= x is None
        node = _Node(tag, here, inside or gone or tag in DROPPED, 0 if tag in ("html", "body") else lean, names)
        here.kids.append(node)
        nodes.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            here = node
        elif tag not in VOID and tag in BLOCK:
            here = node  # a slash doesn't end these
    _settle(nodes)
    return root, nodes


def _settle(nodes: list[_Node]) -> None:
    """Mark readers' comments, and forms that are not around the article, as gone; ``nodes`` are in page order."""
    n = len(nodes)
    at = {id(x): i for i, x in enumerate(nodes)}
    end, chars, prose, holds = [i + 1 for i in range(n)], [0] * n, [0] * n, [False] * n
    for i in range(n - 1, 0, -1):
        x = nodes[i]
        if x.gone:
            continue
        chars[i] += sum(len(k.strip()) for k in x.kids if isinstance(k, str))
        prose[i] = chars[i] if x.tag in PARAGRAPHS else max(prose[i], 0)
        holds[i] |= x.tag in ("article", "main", "h1")
        u = at[id(x.up)]
        chars[u] += chars[i]
        prose[u] += prose[i]
        holds[u] |= holds[i]
    for i in range(n - 1, 0, -1):
        u = at[id(nodes[i].up)]
        end[u] = max(end[u], end[i])
    inside = lambda i: range(i + 1, end[i])

    def drop(i: int) -> None:
        for j in range(i, end[i]):
            nodes[j].gone = True

    for i, x in enumerate(nodes):
        if x.tag == "form" and not x.gone and not (chars[i] >= FORM_CHARS and (holds[i] or 2 * prose[i] > prose[0])):
            drop(i)
    found = []
    for i, x in enumerate(nodes):
        if x.gone or not i:
            continue
        named = x.names & COMMENTS and not x.names & NOT_COMMENTS and x.tag not in ("html", "body", "main")
        if named and any(nodes[j].tag in ("h1", "main") or nodes[j].tag == "article" and not nodes[j].names & COMMENTS for j in inside(i)):
            x.lean = max(x.lean, 0)  # what holds the title is the article, whatever its name
        elif named:
            found.append(i)
        elif x.tag in HEADINGS and x.tag != "h1" and chars[i] <= SIGNATURE_CHARS and _SAYS_COMMENTS.match(" ".join(_own_text(x).split())):
            after = False
            for k in x.up.kids:
                if k is x:
                    after = True
                if after and not isinstance(k, str):
                    if k is not x and k.tag in HEADINGS and k.tag <= x.tag:
                        break
                    if k is x or not holds[at[id(k)]]:
                        found.append(at[id(k)])
    found += _runs(nodes, at, chars, inside)
    away = {j for i in found for j in range(i, end[i])}
    # Where nothing else has text, what is named so must be the article.
    if any(not nodes[i].gone and i not in away and any(isinstance(k, str) and k.strip() for k in nodes[i].kids) for i in range(1, n)):
        for i in found:
            drop(i)


def _runs(nodes: list[_Node], at: dict[int, int], chars: list[int], inside) -> list[int]:
    """Places of like blocks, RUN or more side by side behind other text, each of which is signed and has no heading; articles in an article need no signature."""
    out = []
    first = next((j for j, x in enumerate(nodes) if x.tag in ("p", "pre", "blockquote") and not x.gone and chars[j]), len(nodes))

    def signed(i: int) -> bool:
        for j in inside(i):
            x = nodes[j]
            if x.tag == "time" or x.names & SIGNED:
                return True
            if x.tag not in ("p", "li") and 0 < chars[j] <= SIGNATURE_CHARS and nodes[i].tag != "li" and _SIGNATURE.search(" ".join(_own_text(x).split())):
                return True
        return False

    for x in nodes:
        alike: dict[tuple, list[int]] = {}
        for k in x.kids:
            if not isinstance(k, str) and not k.gone and k.tag in ("div", "section", "article", "li", "dd") and chars[at[id(k)]]:
                alike.setdefault((k.tag, k.names), []).append(at[id(k)])
        for (tag, _), run in alike.items():
            nested, up = False, x
            while tag == "article" and up is not None and not nested:
                nested, up = up.tag == "article", up.up
            if len(run) < (2 if nested else RUN) or any(nodes[j].tag in HEADINGS for i in run for j in inside(i)):
                continue
            if first < run[0] and (nested or all(signed(i) for i in run)):
                out += run
    return out


def _own_text(node: _Node) -> str:
    """The text directly in a node and in its phrases, not in blocks below it."""
    out, stack = [], list(reversed(node.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif not k.gone and k.tag not in BLOCK:
            stack.extend(reversed(k.kids))
    return "".join(out)


def _score(nodes: list[_Node]) -> None:
    """Points, length of text and length of linked text of every node; ``nodes`` are in page order."""
    for x in reversed(nodes):  # what is below a node comes after it
        if x.gone:
            continue
        own = sum(len(k.strip()) for k in x.kids if isinstance(k, str))
        x.chars += own
        if x.tag == "a":
            x.linked = x.chars
        if x.up is not None:
            x.up.chars += x.chars
            x.up.linked += x.linked
        if x.tag in PARAGRAPHS or x.tag in CONTAINERS and own > 0:
            text = _own_text(x).strip()
            if text:
                points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - x.linked / max(1.0, x.chars))
                up, level = (x if x.tag in CONTAINERS else x.up), 0
                if x.tag in PARAGRAPHS and x.lean < 0:
                    points *= AWAY_FACTOR
                while up is not None and level < LEVELS:
                    up.points += points / (level + 1)
                    if up.lean < 0:
                        points *= AWAY_FACTOR  # what is above a block that leans away has little of it
                    up, level = up.up, level + 1
    for x in nodes:
        x.points *= 1 - x.linked / max(1.0, x.chars)
        x.points *= AWAY_FACTOR if x.lean < 0 else TOWARDS_FACTOR if x.lean > 0 else 1.0
        x.points *= ARTICLE_FACTOR if x.tag in ("article", "main") and x.lean >= 0 else 1.0


def _like(k: _Node, best: _Node) -> bool:
    """Whether a block beside the best container reads like it."""
    return not k.gone and k.lean >= 0 and k.points >= max(LEAST_POINTS, BESIDE * best.points) and k.linked < 0.5 * k.chars


def _within(x: _Node | None, top: _Node) -> bool:
    while x is not None and x is not top:
        x = x.up
    return x is not None


def _precedes(k: _Node, x: _Node) -> bool:
    """Whether ``k`` comes before ``x`` among what both are in."""
    return next(c for c in x.up.kids if c is k or c is x) is k


def _only(boxes: list[_Node]) -> _Node | None:
    """The only article with points that is in no other one; if there is no article, the only main element with points."""
    for tag in ("article", "main"):
        found = []
        for x in boxes:
            up = x.up
            while up is not None and up.tag != tag:
                up = up.up
            if x.tag == tag and x.points > 0 and up is None:
                found.append(x)
        if found:
            return found[0] if len(found) == 1 else None
    return None


def _chosen(nodes: list[_Node]) -> tuple[_Node, list[_Node]] | None:
    """The best container, and all blocks that are kept, in page order; None if nothing has points."""
    boxes = [x for x in nodes if not x.gone and x.chars and x.tag in BLOCK and x.tag not in NO_BOX]
    only = _only(boxes)
    if only is not None and only.tag == "article":
        return only, [k for k in nodes if k is only or k.up is only.up and k.tag in HEADINGS and not k.gone and k.lean >= 0 and _precedes(k, only)]
    if only is not None:
        boxes = [x for x in boxes if _within(x, only)]
    best = max(boxes, key=lambda x: x.points, default=None)
    if best is None or best.points <= 0:
        return None
    # An article that the best container is a part of, and that has enough points of its own, is the container.
    x, found = best.up, best
    while x is not None:
        if x.tag in ("article", "main") and not x.gone and x.points >= AROUND * best.points:
            found = x
        x = x.up
    best = found
    kept, x = {id(best)}, best
    while x.up is not None:
        for k in x.up.kids:
            if isinstance(k, str) or k is x or k.gone:
                continue
            if _like(k, best):
                kept.add(id(k))
            elif x is best and k.lean >= 0 and (k.tag in ("p", "blockquote", "pre") and k.linked < 0.25 * k.chars or k.tag in HEADINGS and k.linked < 0.5 * k.chars):
                kept.add(id(k))
        x = x.up
    return best, [x for x in nodes if id(x) in kept]


def _text(node: _Node, best: _Node) -> str:
    """Blocks in page order: references decoded, white space folded, joined by one space; what leans away inside goes."""
    blocks, line, stack, spoken = [], [], [node], False
    above = set()
    x: _Node | None = best
    while x is not None:
        above.add(id(x))
        x = x.up
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            line.append(k)
        elif k is None:
            if line:
                blocks.append("".join(line))
                line = []
        elif k.gone or k.lean < 0 and id(k) not in above and k.points < INSIDE * best.points:
            if k.tag in BLOCK:
                stack.append(None)
        elif k.tag == "br":
            line.append(" ")
        elif k.tag in ("ul", "ol", "dl", "table") and k.chars and k.linked > 0.6 * k.chars and k is not node and not spoken:
            stack.append(None)  # a list of links before the first paragraph is a menu, behind it sources
        else:
            block = k.tag in BLOCK
            spoken = spoken or k.tag in ("p", "pre", "blockquote") and k.chars > 0
            if block:
                stack.append(None)
            stack.extend(reversed(k.kids))
            if block:
                stack.append(None)
    if line:
        blocks.append("".join(line))
    folded = (" ".join(html.unescape(b).split()) for b in blocks)
    return " ".join(b for b in folded if b)


def main_text(page: str | None) -> str:
    """The article of a page as one line of text; empty if the page has none.

    Without points anywhere, as on a page of plain text, the whole page is the article.  Of
    containers with equal points the first in page order is the best.
    """
    if not page:
        return ""
    _, nodes = parse(page)
    _score(nodes)
    found = _chosen(nodes)
    if found is None:
        return _text(nodes[0], nodes[0])
    best, kept = found
    return " ".join(t for t in (_text(k, best) for k in kept) if t)


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (its code points) for the column ``html_col``.

    Null and empty pages, and pages without text, give an empty text; an empty table gives an
    empty one.  Pages are read whole, however long or deep.  The other columns stay, except
    those called text or n_chars, whatever the case; rows are taken one by one, so repeated
    rows repeat.
    """

    @F.pandas_udf("string")
    def article(col: pd.Series) -> pd.Series:
        return col.map(lambda p: main_text(p if isinstance(p, str) else None))

    bounded_batches(pages.sparkSession)
    rest = [quoted(c) for c in pages.columns if c.lower() not in ("text", "n_chars", html_col.lower())]
    return pages.select(*rest, article(quoted(html_col)).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
