"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is read as a stream of tokens: tags, with the classes that say something, and texts. For every
element its children's tokens are aligned with those seen before, in the page and in all others of the
host: what one side lacks becomes optional, what comes again becomes repeated, stretches that cross become
one repeated group, and texts that differ become slots. Every name stands once in an element's
expression, so wrappers don't grow with the number of pages. Wrappers of batches are merged
by the same alignment, a bounded number at a time, until a host has one. It names the element that
holds the article; extraction follows a page's tokens through the wrapper and keeps the text there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm._bytes import small_batches
from lumenvec.llm.linking import cut

#: Wrappers that are merged at a time.
MERGED = 64
#: Bytes of all wrappers up to which they are sent to every task; more are joined by host, hot hosts in parts.
BROADCAST_BYTES = 32 << 20
#: Pages of a part of a host, where wrappers are joined by host.
PART_PAGES = 4096

# Elements and words by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg math select object canvas audio video".split())
#: Those that hold all of the page that follows, if they don't end.
UNENDING = frozenset("script style iframe textarea title xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
CELLS = frozenset("td th".split())
CLOSES_P = BLOCKS - frozenset("body html caption dd dt li legend option optgroup summary tbody tfoot thead tr figcaption".split())
#: Elements that end an open one of the same kind, and what they look for no further than.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"datalist"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tr"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
SCOPE = frozenset("table td th caption button object template html body".split())
NOT_TEXT = frozenset("head nav footer aside form dialog menu search button fieldset".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar widget widgets related recommended recommendations share sharing social "
    "comment comments reply replies disqus respond nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar login search copyright paywall skip".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies disqus respond".split())
MAIN_WORDS = frozenset("article content post entry story main text body".split())

_TOKEN = re.compile(r"""<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>?|<[a-zA-Z][^>]*+\Z""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
#: Classes that say what an element has beside it, not what it is.
_BESIDE = re.compile(r"(has|with|no|without)[-_]", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)")


def _words(name: str) -> list[str]:
    return [p.lower() for p in _PART.findall(name)]


@lru_cache(1 << 14)
def signature(tag: str, attributes: str) -> tuple[str, bool]:
    """(name of a tag with its classes, whether it says itself that it isn't the article); names with three digits or more, which may be another on every page, aren't part of it."""
    found, own = {}, []
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), unescape((m[2] or "").strip("\"'")))
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    said = {p for x in names if not _BESIDE.match(x) for p in _words(x)}
    own = sorted({x for x in found.get("class", "").split() if x.isascii() and sum(c.isdigit() for c in x) < 3})
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
    role = found.get("role", "").lower()
    off = tag in NOT_TEXT or hidden or role in ROLES or (tag not in ("html", "body", "main") and bool(said & ASIDE_WORDS))
    if role == "main" or "articleBody" in found.get("itemprop", ""):
        own.append("=main")
    elif said & MAIN_WORDS and not off:
        own.append("=content")
    return ".".join([tag, *own]) + ("!" if off else ""), off


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, attributes): kind is open, close or text. What is inside raw elements is left out, and so are comments."""
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            yield "text", html[at:], ""
            return
        if m.start() > at:
            yield "text", html[at : m.start()], ""
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            yield "close", tag, ""
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            if end is None and tag in UNENDING:
                return  # it is open to the end of the page
            if end is None:
                continue
            at = end.start()
        yield "open", tag, attributes


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text): enter and leave elements, which nest, breaks and texts. Ends that HTML leaves out are put in."""
    stack: list[str] = []  # tags; inline elements that say nothing have no events but are here for their ends
    told: list[str] = []

    def leave(k: int) -> Iterator[tuple[str, str, str]]:
        while len(stack) > k:
            stack.pop()
            if name := told.pop():
                yield "leave", name, ""

    for kind, tag, more in tokens(html):
        if kind == "text":
            yield "text", tag, ""
        elif kind == "close":
            if tag == "br":
                yield "break", tag, ""
            elif tag in stack:
                k = len(stack) - 1 - stack[::-1].index(tag)
                # an inline element's end doesn't end the blocks around it
                if tag in BLOCKS or tag in CELLS or not any(x in BLOCKS or x in CELLS for x in stack[k + 1 :]):
                    yield from leave(k)
        else:
            if tag in CLOSES_P and "p" in stack:
                k = len(stack) - 1 - stack[::-1].index("p")
                if not SCOPE & set(stack[k:]):
                    yield from leave(k)
            if tag in IMPLIED:
                ends, stop = IMPLIED[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k] in stop:
                        break
                    if stack[k] in ends:
                        yield from leave(k)
                        if tag in ("li", "dt", "dd", "option"):
                            break
            name, off = signature(tag, more)
            if tag in VOID:
                yield "break", tag, ""
                continue
            if not off:
                name = "a" if tag == "a" else name if tag in BLOCKS or tag in CELLS else ""
            stack.append(tag)
            told.append(name)
            if name:
                yield "enter", name, ""
    yield from leave(0)


# ---- expressions: an element's children as factors (names, least, many), each name in one factor


def folded(names: list[str]) -> list[list]:
    """The expression of one row of children: neighbours that are equal repeat, and so does a stretch between equals."""
    out: list[list] = []
    for x in names:
        k = next((k for k, f in enumerate(out) if x in f[0]), None)
        if k is None:
            out.append([[x], 1, 0])
        else:
            group = list(dict.fromkeys(y for f in out[k:] for y in f[0]))
            out[k:] = [[group, 1, 1]]
    return out


def aligned(a: list[list], b: list[list]) -> list[list]:
    """An expression for all that either of two stands for; a group of several names is each of them or not, in order, again and again."""
    out: list[list] = []
    i = j = 0
    where_b = {x: k for k, f in enumerate(b) for x in f[0]}
    where_a = {x: k for k, f in enumerate(a) for x in f[0]}
    while i < len(a) or j < len(b):
        ahead_b = max((where_b.get(x, -1) for x in a[i][0]), default=-1) if i < len(a) else -1
        ahead_a = max((where_a.get(x, -1) for x in b[j][0]), default=-1) if j < len(b) else -1
        if i < len(a) and ahead_b < j:
            out.append([a[i][0], 0, a[i][2]])
            i += 1
        elif j < len(b) and ahead_a < i:
            out.append([b[j][0], 0, b[j][2]])
            j += 1
        elif ahead_a == i and ahead_b == j and len(a[i][0]) == len(b[j][0]) == 1:
            out.append([a[i][0], min(a[i][1], b[j][1]), max(a[i][2], b[j][2])])
            i, j = i + 1, j + 1
        else:
            # the stretch on both sides up to where no name is left on one side only
            p, q = i, j
            while True:
                p2 = max([p, *(where_a.get(x, p) for f in b[j : q + 1] for x in f[0])])
                q2 = max([q, *(where_b.get(x, q) for f in a[i : p2 + 1] for x in f[0])])
                if (p2, q2) == (p, q):
                    break
                p, q = p2, q2
            left, right = a[i : p + 1], b[j : q + 1]
            names = list(dict.fromkeys(x for f in left + right for x in f[0]))
            out.append([names, int(any(f[1] for f in left) and any(f[1] for f in right)), 1])
            i, j = p + 1, q + 1
    return out


TEXT = "#"


class Wrapper:
    """Elements by path (a number each; 0 is the page), each with its expression, and what its texts hold.

    own[k]: [pages, words, words in links, the text if it was always the same, else None] of the text
    directly in element k.
    """

    def __init__(self):
        self.pages = 0
        self.child: dict[tuple[int, str], int] = {}
        self.parent, self.name = [-1], [""]
        self.body: list[list | None] = [None]
        self.own: list[list] = [[0, 0, 0, None]]
        self.seen: set = set()

    def node(self, parent: int, name: str) -> int:
        k = self.child.get((parent, name))
        if k is None:
            k = self.child[parent, name] = len(self.name)
            self.parent.append(parent), self.name.append(name), self.body.append(None), self.own.append([0, 0, 0, None])
        return k

    def align(self, k: int, body: list[list]) -> None:
        self.body[k] = body if self.body[k] is None else aligned(self.body[k], body)

    def add(self, html: str) -> None:
        """Aligns the expression with a page."""
        self.pages += 1
        stack: list[tuple[int, list[str]]] = [(0, [])]
        links, texts = 0, {}
        for kind, name, _ in events(html):
            k, row = stack[-1]
            if kind == "enter":
                if name == "a":
                    links += 1
                    stack.append((k, row))  # links are told apart in texts only
                    continue
                if row[-2:] != [name, name]:  # twice stands for again and again
                    row.append(name)
                stack.append((self.node(k, name), []))
            elif kind == "leave":
                stack.pop()
                if name == "a" and links:
                    links -= 1
                elif name != "a":
                    self._close(k, row)
            elif kind == "text" and (n := len(name.split())):
                if row[-1:] != [TEXT]:
                    row.append(TEXT)
                got = texts.setdefault(k, [0, 0, []])
                got[0] += n
                got[1] += n if links else 0
                got[2].append(name)
        self._close(*stack[0])
        for k, (n, linked, parts) in texts.items():
            self._text(k, 1, n, linked, unescape(" ".join(" ".join(parts).split())))

    def _close(self, k: int, row: list[str]) -> None:
        key = (k, tuple(row))
        if key not in self.seen:  # aligning once more would change nothing
            self.seen.add(key)
            self.align(k, folded(row))

    def _text(self, k: int, pages: int, n: int, linked: int, text: str | None) -> None:
        own = self.own[k]
        own[3] = text if not own[0] else text if text == own[3] else None
        own[0] += pages
        own[1] += n
        own[2] += linked

    def merge(self, other: Wrapper) -> None:
        to = [0]
        for k in range(1, len(other.name)):
            to.append(self.node(to[other.parent[k]], other.name[k]))
        self.pages += other.pages
        for k, at in enumerate(to):
            if other.body[k] is not None:
                self.align(at, other.body[k])
            if other.own[k][0]:
                self._text(at, *other.own[k])

    def dumps(self) -> str:
        # a text that was always the same is kept as its hash: only whether it stays the same matters
        own = [[*x[:3], x[3] if x[3] is None or len(x[3]) < 40 else _digest(x[3])] for x in self.own]
        return json.dumps([self.pages, self.parent, self.name, self.body, own], separators=(",", ":"))

    @classmethod
    def loads(cls, raw: str) -> Wrapper:
        out = cls()
        out.pages, out.parent, out.name, out.body, out.own = json.loads(raw)
        out.child = {(out.parent[k], out.name[k]): k for k in range(1, len(out.name))}
        return out

    def expression(self, k: int = 0) -> str:
        """The wrapper from element k as text: ? optional, + repeated, * both; # is a slot, and a text that never changes is quoted."""
        out, work = [], [(k, None)]
        while work:
            k, said = work.pop()
            if said is not None:
                out.append(said)
                continue
            for names, least, many in reversed(self.body[k] or []):
                work.append((k, ("*" if many else "?") if not least else "+" if many else ""))
                if len(names) > 1:
                    work.append((k, ")"))
                for x in reversed(names):
                    if len(names) > 1:
                        work.append((k, "? " if x != names[-1] else "?"))
                    if x == TEXT:
                        same = self.own[k][3]
                        work.append((k, TEXT if same is None or self.pages == 1 else json.dumps(same, ensure_ascii=False)))
                    else:
                        at = self.child[k, x]
                        work += [(at, ")"), (at, None), (at, x + "(")]
                if len(names) > 1:
                    work.append((k, "("))
                work.append((k, " "))
        return "".join(out).replace("( ", "(").strip()

    def main(self) -> list[int]:
        """Elements that may hold the article, the best first."""
        n = len(self.name)
        off = [False] * n
        tags = [x.split(".")[0].rstrip("!") for x in self.name]
        said = [x.endswith("!") for x in self.name]
        holds = [False] * n  # it, or one inside it, is an article by its name
        every = [0] * n  # words of all in it but what its own kind rules out
        for k in range(n - 1, 0, -1):
            if tags[k] in NOT_TEXT:
                continue
            holds[k] = holds[k] or (tags[k] in ("article", "main") and not said[k]) or ".=main" in self.name[k]
            every[k] += self.own[k][1]
            holds[self.parent[k]] |= holds[k]
            every[self.parent[k]] += every[k]
        # classes alone don't rule out what the article, or most of the page, is in; comments may be most of it
        most = [holds[k] or (2 * every[k] > every[0] and not COMMENT_WORDS & set(_words(self.name[k]))) for k in range(n)]
        # what is only called a header, inside the article, has its title
        most = [x or (ASIDE_WORDS & set(_words(self.name[k])) == {"header"} and self._within(k, tags, ("article", "main"))) for k, x in enumerate(most)]
        words, linked, slots = ([0] * n for _ in range(3))
        for k in range(1, n):
            inside = off[self.parent[k]]
            off[k] = inside or (said[k] and (tags[k] in NOT_TEXT or not most[k])) or (tags[k] == "header" and not self._within(k, tags, ("article", "main")))
            if not off[k]:
                words[k], linked[k] = self.own[k][1], self.own[k][2]
                slots[k] = words[k] - linked[k] if self.own[k][3] is None or self.pages < 3 else 0
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            words[up], linked[up], slots[up] = words[up] + words[k], linked[up] + linked[k], slots[up] + slots[k]
        self.off, self.linked, self.words, self.slots = off, linked, words, slots

        def best(of: list[int]) -> list[int]:
            return sorted(of, key=lambda k: (-slots[k], -words[k], k))

        live = [k for k in range(1, n) if not off[k] and words[k]]
        article = [k for k in live if tags[k] == "article" and not self._within(k, tags, ("article",))]
        mains = [k for k in live if tags[k] == "main" or ".=main" in self.name[k]]
        content = [k for k in live if ".=content" in self.name[k] and 2 * slots[k] > slots[0] and tags[k] not in ("body", "html")]
        # a smaller element that holds nearly all of a larger one is the closer of the two
        content.sort(key=lambda k: (-round(4 * slots[k] / max(slots[0], 1)), -k))
        return list(dict.fromkeys([*best(article), *best(mains), *content, self._densest(off, tags, slots)]))

    def _within(self, k: int, tags: list[str], which: tuple[str, ...]) -> bool:
        k = self.parent[k]
        while k > 0:
            if tags[k] in which:
                return True
            k = self.parent[k]
        return False

    def _densest(self, off: list[bool], tags: list[str], slots: list[int]) -> int:
        """From the page down, while one container has two thirds of the texts that change."""
        k = 0
        below: dict[int, list[int]] = {}
        for x in range(1, len(tags)):
            below.setdefault(self.parent[x], []).append(x)
        while True:
            down = [x for x in below.get(k, ()) if not off[x] and tags[x] in BLOCKS | CELLS and tags[x] not in ("p", "li", "ul", "ol", "blockquote", "pre") and not re.match(r"h\d", tags[x]) and 3 * slots[x] >= 2 * slots[k] > 0]
            if not down:
                return k
            k = down[0]

    def plan(self) -> str:
        """What extraction needs: elements, those to choose from, and those whose text never counts."""
        main = self.main()
        by_name = {k for k in main if re.match(r"(article|main)\b", self.name[k]) or ".=main" in self.name[k]}
        off = list(self.off)
        # where nothing is called the article, lists of links and texts that never change aren't part of it
        thin = [k for k in range(1, len(off)) if self.words[k] and 10 * self.linked[k] >= 7 * self.words[k]]
        same = [k for k in range(1, len(off)) if self.pages >= 3 and self.words[k] and not self.slots[k]] if self.slots[0] else []
        return json.dumps([self.parent, self.name, main, sorted(by_name), [k for k, x in enumerate(off) if x], sorted({*thin, *same} - set(main))], separators=(",", ":"))


def _digest(text: str) -> str:
    import hashlib

    return "#" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


class Plan:
    def __init__(self, raw: str):
        parent, name, self.main, named, off, thin = json.loads(raw)
        self.child = {(parent[k], name[k]): k for k in range(1, len(name))}
        self.named, self.off, self.thin = set(named), set(off), set(thin)

    def extract(self, html: str) -> str:
        """The text of the best element that the page has, a line a block."""
        blocks: list[tuple[int, set[int], bool, bool, str]] = []
        # (element, those among `main` that it is in, whether it never counts, whether it counts only in named ones)
        stack = [(0, frozenset({0} & set(self.main)), False, False)]
        mains, buffer = set(self.main), []

        def flush() -> None:
            if buffer:
                if text := " ".join(unescape("".join(buffer)).split()):
                    blocks.append((*stack[-1], text))
                buffer.clear()

        for kind, name, _ in events(html):
            if kind == "text":
                buffer.append(name)
            elif kind == "break":
                if name == "hr":
                    flush()
                elif name != "wbr":
                    buffer.append(" " if name == "br" else "")
            elif name == "a":
                if kind == "enter":
                    stack.append(stack[-1])
                else:
                    stack.pop()
            elif kind == "enter":
                k, inside, off, thin = stack[-1]
                if name.split(".")[0] in CELLS:
                    buffer.append(" ")
                else:
                    flush()
                k = self.child.get((k, name), -1)
                stack.append((k, inside | {k} if k in mains else inside, off or k in self.off, thin or k in self.thin))
            elif name in CELLS:
                stack.pop()
                buffer.append(" ")
            else:
                flush()
                stack.pop()
        flush()
        for m in self.main:
            got = [text for _, inside, off, thin, text in blocks if m in inside and not off and (m in self.named or not thin)]
            if got:
                return "\n".join(got)
        return ""


_plan = lru_cache(256)(Plan)


def host(url: str | None) -> str:
    """The url's host in lower case, without user or port; empty if there is none."""
    m = _HOST.match(url or "")
    return m[1].lower().partition(":")[0] if m else ""


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of (url, html): each host's wrapper, inferred from all of its pages.

    A batch of pages gives a wrapper for each host in it; these are merged by host, MERGED at a time.
    """
    small_batches(pages.sparkSession)

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, Wrapper] = {}
            for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(host(url), Wrapper()).add(html or "")
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([x.dumps() for x in found.values()], pa.string())], ["host", "wrapper"])

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        out = Wrapper()
        for raw in sorted(rows.column("wrapper").to_pylist()):
            out.merge(Wrapper.loads(raw))
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([out.dumps()], pa.string())})

    found = cut(pages.select(pages["url"].cast("string"), pages["html"].cast("string")).mapInArrow(infer, "host string, wrapper string"))
    most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    while True:
        most = -(-most // MERGED)
        found = found.select("host", "wrapper", F.pmod(F.xxhash64("wrapper"), F.lit(most)).alias("part")).groupBy("host", "part").applyInArrow(join, "host string, wrapper string")
        if most == 1:
            return cut(found)


def plans(wrapped: DataFrame) -> DataFrame:
    """(host, n_pages, expression, plan) of (host, wrapper)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [Wrapper.loads(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.pages for x in own], pa.int64()), pa.array([x.expression() for x in own], pa.string()), pa.array([x.plan() for x in own], pa.string())], ["host", "n_pages", "expression", "plan"])

    return wrapped.select("host", "wrapper").mapInArrow(run, "host string, n_pages bigint, expression string, plan string")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` by its host's wrapper.

    A null html is empty and gives an empty text, as a page without an article does; pages without a url, or with
    one that has no host, share a wrapper. Repeated rows give a row each; an empty table gives
    none. Pages are read whole, however long. Columns other than page_id, url and html aren't looked
    at, whatever they are called. Of elements that fit equally well the first in the page is taken.
    """
    small_batches(pages.sparkSession)
    known = cut(plans(wrappers(pages)).select("host", "n_pages", "plan"))
    size = known.agg(F.sum(F.length("plan"))).first()[0] or 0

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([host(x) for x in b.column(1).to_pylist()], pa.string())], ["page_id", "url", "html", "host"])

    rows = pages.select(pages["page_id"].cast("bigint"), pages["url"].cast("string"), pages["html"].cast("string"))
    if size <= BROADCAST_BYTES:
        held = pages.sparkSession.sparkContext.broadcast({r["host"]: r["plan"] for r in known.select("host", "plan").toLocalIterator()})

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield _texts(b, [held.value[host(x)] for x in b.column(1).to_pylist()])

        return rows.mapInArrow(here, "page_id bigint, url string, text string, n_chars bigint")
    # hot hosts in parts: their plan stands once for each part
    parts = F.ceil(F.col("n_pages") / F.lit(PART_PAGES)).cast("int")
    dealt = known.select("host", "plan", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), parts.alias("parts"))
    own = rows.mapInArrow(hosts, "page_id bigint, url string, html string, host string").join(known.select("host", parts.alias("parts")), "host")
    own = own.withColumn("part", F.pmod(F.xxhash64("page_id", "html"), F.col("parts")).cast("int"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _texts(b, b.column(3).to_pylist())

    return own.join(dealt.drop("parts"), ["host", "part"]).select("page_id", "url", "html", "plan").mapInArrow(joined, "page_id bigint, url string, text string, n_chars bigint")


def _texts(b: pa.RecordBatch, plan: list[str]) -> pa.RecordBatch:
    texts = [_plan(p).extract(x or "") for p, x in zip(plan, b.column(2).to_pylist())]
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


__all__ = ["extract", "plans", "wrappers", "Wrapper", "Plan"]
