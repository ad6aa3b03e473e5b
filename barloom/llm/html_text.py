"""Main text of HTML pages by composite text density.

Markup is read into one tree of nodes, menus, comments and adverts included. Every node has C characters, T tags, LC characters
inside links and LT link tags below it; its density is the link-adjusted number of characters per tag,

    C / T * log( C / LC * T / LT ) / log( log( C / nLC * LC + LCb / Cb * C + e ) + e - 1 )

with nLC = C - LC and body totals Cb, LCb (zero counts read as 1), or C / T without links. Formatting elements
count as their block's text. A node's sum is that of its children's densities. The node of the largest sum is the core; the
least density on the path from the body to it is the threshold. The text is the core's, and that of headings and of other nodes
that reach the threshold below the same article (or body, where the core stands in no article).

Tags and class names choose nothing, they only prune: parts that never hold an article (forms, asides, what is hidden, parts
named as adverts or comments) are cut out of the text chosen, and a core inside such a part yields to the next. A name, or a form, header or hidden part, is not believed
where it stands for most of the page's text. Reading, densities and pruning are linear in the page.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import map_texts

# Element names by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object xmp noembed noframes".split())
DROPPED = set("head nav footer aside form button select option label fieldset dialog menu canvas audio video map applet frameset input".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: What stands in a head; any other element ends it.
HEAD = set("head meta link base script style title noscript template".split())
#: Elements that end an open paragraph.
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that end an open one of their own kind.
ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SCOPES = set("article body div section main table ul ol td th html".split())
#: Words in class, id or role that mark a part as no article.
MARKS = set(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination "
    "sidebar aside footer masthead header topbar toolbar notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond reply replies discussion social share sharing related recommended widget skip search form copyright legal disclaimer".split()
)
#: Of these, words whose parts often outweigh a short article: names with them are believed however much they hold.
FIRM = set("cookie cookies consent gdpr comment comments commentlist disqus respond reply replies".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)|([^<]+|<)""", re.S
)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAMED = ("class", "id", "role", "aria-label")
#: Of the dropped elements, those that may stand around a whole page; so may a header outside an article and what is hidden.
WRAPS = set("form fieldset dialog".split())
#: And those whose text is no article even on a page without any.
NEVER = set("head nav footer menu button select option label input".split())
#: End tags of raw elements, in the source as it stands (lower-casing all of it would shift offsets).
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
UNSEEN = re.compile(r"display\s*:\s*none", re.I)


def _attributes(attrs: str) -> dict[str, str]:
    """By lower-case name, the first of each."""
    out: dict[str, str] = {}
    for m in ATTR.finditer(attrs):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _marked(tag: str, attrs: dict[str, str], inside_article: bool) -> tuple[bool, str]:
    """Whether a part is left out whatever it holds, and the mark of one that is left out unless it holds most of the page: by its tag, or
    as it is hidden."""
    if tag in WRAPS or (tag == "header" and not inside_article):
        return False, f"<{tag}>"
    if tag in DROPPED:
        return True, ""
    if "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or UNSEEN.search(attrs.get("style", "")):
        return False, "hidden"
    return False, ""


def _names(tag: str, attrs: dict[str, str], inside_article: bool) -> dict[str, bool]:
    """The names of a part that mark it as no article, and whether each is sure: made of such words alone, or with a firm one."""
    found: dict[str, bool] = {}
    if not attrs or tag in ("main", "h1", "h2") or tag == "article" and not inside_article:
        return found
    for attribute in NAMED:
        value = re.sub(r"([a-z])([A-Z])", r"\1-\2", attrs.get(attribute, "")).lower()
        for name in value.split():
            words = re.findall(r"[a-z]+", name)
            # names such as has-sidebar or no-ads speak of another part
            if words and words[0] not in ("has", "with", "no", "is") and any(w in MARKS for w in words):
                if attribute == "aria-label":  # a label is one name
                    name, words = value, re.findall(r"[a-z]+", value)
                found[name] = all(w in MARKS for w in words) or any(w in FIRM for w in words)
    return found


class Page:
    """The tree of a page as arrays in document order, and its text blocks.

    hard tells which nodes are no article by their tag, names has the marks of others (names, hidden, tags that may wrap a page): each with whether it is sure.
    """

    def __init__(self, source: str):
        self.tag, self.parent = ["body"], [-1]
        self.own, self.linked = [0], [0]
        self.hard: set[int] = set()
        self.names: dict[int, dict[str, bool]] = {}
        self.blocks: list[tuple[int, str]] = []
        open_, owners = [0], [0]  # open nodes, and for each the block it stands in
        depths: dict[str, list[int]] = {}  # of open elements, by tag
        scopes: list[int] = [0]
        buffer: list[str] = []
        owner = 0

        def flush() -> None:
            if buffer:
                if text := " ".join("".join(buffer).split()):
                    self.blocks.append((owner, text))
                buffer.clear()

        def close(upto: int) -> None:
            while len(open_) > upto:
                tag = self.tag[open_.pop()]
                owners.pop()
                depths[tag].pop()
                if tag in SCOPES:
                    scopes.pop()
                if tag not in INLINE:
                    flush()

        def find(names: set[str]) -> int | None:
            """The depth of the innermost open element of these, if no scope has begun since."""
            depth = max((depths[t][-1] for t in names if depths.get(t)), default=0)
            return depth if depth and depth >= scopes[-1] else None

        at = 0
        while m := TOKEN.match(source, at):
            at = m.end()
            if m[7] is not None:
                text = html.unescape(m[7]) if "&" in m[7] else m[7]
                if not buffer:
                    owner = owners[-1]
                buffer.append(text)
                n = sum(map(len, text.split()))
                self.own[open_[-1]] += n
                if depths.get("a"):
                    self.linked[open_[-1]] += n
                continue
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if tag == "p" and find({"p"}) is None:
                    flush()
                elif depths.get(tag):
                    close(depths[tag][-1])
                elif tag not in INLINE:
                    flush()
                continue
            attrs = m[3] or m[6] or ""
            if tag in RAW:
                if not attrs.endswith("/") or tag not in ("svg", "math"):
                    end = RAW_END[tag].search(source, at)
                    at = (source.find(">", end.start()) + 1 or len(source)) if end else len(source)
                continue
            if depths.get("head") and tag not in HEAD:
                close(depths["head"][0])
            if tag in ("html", "body"):
                continue
            if tag in ENDS_P and (depth := find({"p"})) is not None:
                close(depth)
            if tag in ENDS_OWN and (depth := find(ENDS_OWN[tag])) is not None:
                close(depth)
            if tag == "a" and (depth := find({"a"})) is not None:
                close(depth)
            if tag == "br":
                buffer.append(" ") if buffer else None
            if tag not in INLINE:
                flush()
            inside_article = bool(depths.get("article") or depths.get("main"))
            known = _attributes(attrs) if attrs else {}
            hard, mark = _marked(tag, known, inside_article)
            names = {} if hard else _names(tag, known, inside_article) | ({mark: False} if mark else {})
            if tag in INLINE and tag != "a" and not hard and not names:
                continue  # formatting is no structure: its text is its block's
            if tag in INLINE and (hard or names):
                flush()  # what may be cut out is a block of its own
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(open_[-1])
            self.own.append(0)
            self.linked.append(0)
            if hard:
                self.hard.add(node)
            if names:
                self.names[node] = names
            if tag in VOID or attrs.endswith("/") and tag not in ("p", "div", "a"):
                continue
            depths.setdefault(tag, []).append(len(open_))
            if tag in SCOPES:
                scopes.append(len(open_))
            owners.append(node if tag not in INLINE or hard or names else owners[-1])
            open_.append(node)
        close(1)
        flush()
        self._count()

    def _count(self) -> None:
        """Characters and tags below each node, densities and sums of the whole tree."""
        n = len(self.tag)
        self.chars, self.link_chars, tags, link_tags = self.own[:], self.linked[:], [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            self.chars[p] += self.chars[i]
            self.link_chars[p] += self.link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        ratio = self.link_chars[0] / (self.chars[0] or 1)

        def density(i: int) -> float:
            c, lc = self.chars[i], self.link_chars[i]
            if not c:
                return 0.0
            if not lc:
                return c / (tags[i] or 1)  # both logarithms cancel without links
            t, lt = tags[i] or 1, link_tags[i] or 1
            inner = c / max(1, c - lc) * lc + ratio * c + math.e
            return c / t * max(0.0, math.log(c / lc * t / lt)) / math.log(math.log(inner) + math.e - 1)

        self.densities = [density(i) for i in range(n)]
        self.sums = [0.0] * n
        for i in range(1, n):
            self.sums[self.parent[i]] += self.densities[i]

    def _cut(self, marks: set[int]) -> list[bool]:
        """Which nodes lie in a marked part."""
        cut = [False] * len(self.tag)
        for i in range(1, len(cut)):
            cut[i] = i in marks or cut[self.parent[i]]
        return cut

    def marks(self) -> set[int]:
        """Nodes to prune: hard ones, those with sure names, and those with other names unless all of these are in doubt, as more than
        half of the text outside links stands below each."""
        sure = self.hard | {i for i, names in self.names.items() if any(names.values())}
        cut = self._cut(sure)
        plain = [0 if cut[i] else self.own[i] - self.linked[i] for i in range(len(cut))]
        for i in range(len(plain) - 1, 0, -1):
            plain[self.parent[i]] += plain[i]
        held: dict[str, int] = {}
        upto: dict[str, int] = {}  # the last node below the outermost one of a name
        for i, names in self.names.items():
            for name in names:
                if not cut[i] and i > upto.get(name, 0):  # text below a name twice counts once
                    held[name] = held.get(name, 0) + plain[i]
                    upto[name] = self._last(i)
        return sure | {i for i, names in self.names.items() if any(2 * held.get(name, 0) <= plain[0] for name in names)}

    def never(self) -> set[int]:
        return {i for i in self.hard if self.tag[i] in NEVER}

    def _last(self, i: int) -> int:
        if not hasattr(self, "_lasts"):
            self._lasts = list(range(len(self.tag)))
            for j in range(len(self.tag) - 1, 0, -1):
                self._lasts[self.parent[j]] = max(self._lasts[self.parent[j]], self._lasts[j])
        return self._lasts[i]

    def text(self, marks: set[int]) -> str:
        """What density chooses, without the parts below marks."""
        n, cut = len(self.tag), self._cut(marks)
        core = max((i for i in range(n) if not cut[i]), key=lambda i: (self.sums[i], -i))
        scope, threshold, path, up = 0, self.densities[core], {core}, core
        while up > 0:
            if not scope and self.tag[up] in ("article", "main"):
                scope = up
            up = self.parent[up]
            path.add(up)
            threshold = min(threshold, self.densities[up])
        inside, taken = [False] * n, [False] * n
        for i in range(scope, n):
            inside[i] = i == scope or inside[self.parent[i]]
            if inside[i] and (i in self.hard or i in self.names or self.tag[i] not in INLINE):
                taken[i] = i == core or (i != scope and taken[self.parent[i]]) or (
                    i != scope and i not in path and (self.densities[i] >= threshold or self.tag[i] in HEADINGS and not self.link_chars[i])
                )
            elif i != scope and inside[i]:
                taken[i] = i == core or taken[self.parent[i]]
        return "\n\n".join(t for owner, t in self.blocks if not cut[owner] and (taken[owner] or owner == scope))


def main_text(source: str | None) -> str:
    """The main text of one page: blocks in page order joined by two line ends; "" for null or empty pages.

    Where no text is left otherwise, names and what is hidden count for nothing, and then neither do tags but those of menus, footers and controls.
    """
    if not source:
        return ""
    page = Page(source)
    return page.text(page.marks()) or (page.text(page.hard) if page.names else "") or (page.text(page.never()) if page.hard else "")


def extract(pages: DataFrame, keep: list[str] | None = None, source: str = "html") -> DataFrame:
    """The columns keep (default: page_id, url) of every row, text and n_chars (code points).

    Null, empty or text-free pages give an empty text. Rows are independent: ties, repeats and null keys
    each get their row, and columns of other names don't matter. Long and deeply nested pages are read whole, in linear time; an empty table
    gives no rows.
    """

    def run(them: list[str | None]) -> dict[str, pa.Array]:
        texts = [main_text(x) for x in them]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

    return map_texts(pages, keep or ["page_id", "url"], source, "text string, n_chars long", run)
