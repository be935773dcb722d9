"""Main text of web pages by consensus host paths.

Every page is parsed and its containers are scored by the running text below them. Each container near the
best votes for its generalised path (tags with their classes and ids, digits as N; known by a hash); Spark adds
the votes up for each host, and a page is extracted again from its containers on the host's winning path. A page
that has none there, or hardly any text, is extracted from its own best one.

Elements whose tag, class or role marks menus, notices, adverts, forms, comments and the like are left out. As such
names also stand on elements around an article, this is decided when a page is parsed: a marked element
stays if it holds far more running text than all that is not marked, and something in it looks like an article. A
marked inline element, a link or a word of code say, stays within a sentence, and goes where it is one of its own.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import html as html_lib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_up, materialize, pieces, read_table, spread_join
from .url_filter import url_host

#: Winners up to this many hosts are broadcast (about 100 bytes each); more are joined by shuffling, where the
#: hosts of many pages are still broadcast.
BROADCAST_HOSTS = 100_000
#: Containers of at least this part of the page's best score vote, with the fourth power of that part.
NEAR_BEST = 0.5
#: With less than this part of its best score on the winning path, a page is extracted from its own best container.
SMALL_PART = 0.05
#: Of several containers without class or id on the path, those with this part of the largest one's score count.
LIKE_PART = 0.25
#: A marked element stays if it has more than so many times the running text that is not marked.
STAYS = 4
#: Running text in blocks of at least the first number that alone shows an article, and how much of it.
LONG_BLOCK, LONG_TEXT = 80, 500

_TOKEN = re.compile(r"""<(?:!--(?:.*?-->|>|.*)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|$)|[!?/][^>]*+(?:>|$))""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'=/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s"'=/]+)""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Classes that only say what else a page has, or has not.
_SAYS = re.compile(r"\b(?:has|with|no|without|show|hide)[-_][\w-]+", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, or is none of the page's text; the first ones go to the end if never closed.
RAW = frozenset("script style title textarea noscript template iframe noembed noframes object svg annotation annotation-xml canvas audio video select datalist".split())
RAW_TO_END = frozenset("script style title textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
                   "math semantics mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle mspace mover munder munderover mpadded mphantom menclose mtable mtr mtd mlabeledtr".split())
CONTAINER = frozenset("body div article section main td center table tbody tr".split())
#: How an element is marked: as layout round an article or beside it, as page furniture, as what others wrote, as unseen.
BESIDE, FURNITURE, REPLIES, UNSEEN = 1, 2, 3, 4
TAGS = {**dict.fromkeys(("aside", "form", "fieldset"), BESIDE), **dict.fromkeys(("nav", "footer"), FURNITURE), **dict.fromkeys(("head", "button", "menu", "dialog"), UNSEEN)}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark what is not the article.
MARKS = {
    **dict.fromkeys("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside widget widgets share sharing social popup modal overlay".split(), BESIDE),
    **dict.fromkeys("nav navbar navigation menu breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login pagination pager copyright skip toolbar".split(), FURNITURE),
    **dict.fromkeys("related recommended recommendations comment comments disqus reply replies respond response responses discussion discussions reactions feedback talkback guestbook".split(), REPLIES),
}
#: Words that, beside a mark in one class or id, name a part of an article after all.
PARTS = frozenset("quote quotation pullquote blockquote code caption figure formula equation price footnote definition example paragraph prose sentence".split())
GOOD = frozenset("article post entry content story main text body".split())
WEIGHTS = {"article": 1.6, "main": 1.4, "td": 0.9, "table": 0.7, "tbody": 0.7, "tr": 0.7}
#: What an open element of the key ends when one of its tags comes.
ENDS = {"p": frozenset(("p",)), "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")),
        "th": frozenset(("td", "th", "p")), "option": frozenset(("option",))}
#: What ends a sentence, and what goes on with one.
_STOPS, _GO_ON = frozenset(".!?…。！？"), frozenset(".,;:!?…)]}%*/+-=’”»")
_BREAKS_P = frozenset(("p",))
_SCOPE = frozenset("ul ol dl table div article section main body aside nav form footer header blockquote td th".split())


@functools.lru_cache(4_096)
def _look(name: str, raw: str) -> tuple[int, str, bool, bool]:
    """How the attributes mark an element, its part of a path, whether a name of it is one of an article, and whether all its
    marks also name a part of one."""
    given: dict[str, str] = {}
    for k, a, b, c, bare in _ATTRIBUTE.findall(raw):
        given.setdefault((k or bare).lower(), a or b or c)
    names = _SAYS.sub(" ", f"{given.get('class', '')} {given.get('id', '')}")
    words = {w.lower() for w in _WORDS.findall(names)}
    mark = max((MARKS[w] for w in words & MARKS.keys()), default=0)
    each = [{w.lower() for w in _WORDS.findall(n)} for n in names.split()]
    part = bool(mark) and all(own & PARTS for own in each if own & MARKS.keys())
    if name in ("article", "main"):
        mark = REPLIES if mark == REPLIES else 0
    elif not mark and given.get("role", "").lower() in ROLES:
        mark = FURNITURE
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(given.get("style", "")):
        mark = UNSEEN
    label = name + "".join("." + c for c in sorted(given.get("class", "").split())) + ("#" + given["id"] if given.get("id") else "")
    return mark, re.sub(r"\d+", "N", label), bool(words & GOOD), part and mark not in (FURNITURE, UNSEEN)


def _sentences(pieces: list[tuple[int, bool, str]]) -> list[tuple[int, bool, str]]:
    """The pieces of a block without the marked ones that are no part of a sentence of others: text ends before them, or
    there is none, and begins anew after them, or there is none."""
    groups = [(k, list(g)) for k, g in itertools.groupby(pieces, key=lambda p: p[0] > 0)]
    said = ["".join(piece for _, _, piece in g).strip() for _, g in groups]
    # a group of nothing but white space has what lies beyond it for a neighbour
    before = lambda i: next((said[j] for j in range(i - 1, -1, -1) if said[j] and not groups[j][0]), "")
    after = lambda i: next((said[j] for j in range(i + 1, len(said)) if said[j] and not groups[j][0]), "")
    alone = [k and before(i)[-1:] in ("", *_STOPS) and not (after(i)[:1].islower() or after(i)[:1] in _GO_ON and after(i)) for i, (k, _) in enumerate(groups)]
    return [p for (_, g), gone in zip(groups, alone, strict=True) if not gone for p in g]


class Page:
    """Blocks of text in page order and the nodes they stand in: containers and marked elements.

    What is kept of a node does not grow with its depth, so the memory is in proportion to the source.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self.parents: list[int] = []
        self.paths: list[int] = []
        self.depths: list[int] = []
        self.weights: list[float] = []  # 0: cannot be extracted
        self.bare: list[bool] = []
        self.marks: list[int] = []
        self.signs: list[int] = []  # 1: an article may begin here, 2: a heading or the main part
        self.in_article: list[bool] = []
        self._node(-1, "body", "body", 0, False)
        self._parse(source)
        self.out = self._left_out()

    def _node(self, parent: int, name: str, label: str, mark: int, good: bool) -> int:
        above = self.paths[parent] if parent >= 0 else 0
        self.parents.append(parent)
        self.paths.append(int.from_bytes(hashlib.blake2b(above.to_bytes(8, "little", signed=True) + label.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
        self.depths.append(self.depths[parent] + 1 if parent >= 0 else 0)
        self.weights.append(0.8 if parent < 0 else 1.3 if good and name in ("div", "section", "td") else WEIGHTS.get(name, 1.0) if name in CONTAINER else 0.0)
        self.bare.append(label == name and name not in ("article", "main"))
        self.marks.append(mark)
        self.signs.append(2 if name == "main" else 1 if mark != REPLIES and name == "article" or good and mark <= BESIDE else 0)
        self.in_article.append(name in ("article", "main") or parent >= 0 and self.in_article[parent])
        return len(self.parents) - 1

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = []  # open elements: (name, node)
        open_at: dict[str, list[int]] = defaultdict(list)  # their places in the stack by name
        scopes: list[int] = []
        node, links = 0, 0
        text: list[tuple[int, bool, str]] = []  # (whether in a marked inline element, whether in a link, source)
        around: dict[int, int] = {}  # what each marked inline element's node stands in
        marked: list[tuple[int, bool]] = []  # (place in the stack, whether it is hidden) of those that are open
        at, n = 0, len(source)
        body_seen = False

        def flush() -> None:
            if text:
                kept = text if all(not m for m, _, _ in text) or open_at["pre"] else _sentences(text)
                joined = "".join(piece for _, _, piece in kept)
                words = " ".join((html_lib.unescape(joined) if "&" in joined else joined).split())
                if words:
                    self.blocks.append((around.get(node, node), words, sum(len(piece) for _, link, piece in kept if link)))
                text.clear()

        def push(name: str, own: int) -> None:
            nonlocal node
            open_at[name].append(len(stack))
            if name in _SCOPE:
                scopes.append(len(stack))
            stack.append((name, own))
            node = own

        def cut(depth: int) -> None:
            nonlocal node
            while len(stack) > depth:
                name, _ = stack.pop()
                open_at[name].pop()
                if scopes and scopes[-1] == len(stack):
                    scopes.pop()
                if marked and marked[-1][0] == len(stack):
                    marked.pop()
            node = stack[-1][1] if stack else 0

        while at < n:
            m = _TOKEN.search(source, at)
            piece = source[at : m.start()] if m else source[at:]
            if piece and not (marked and any(hidden for _, hidden in marked)):
                # a reference never reaches over markup
                text.append((len(marked), links > 0, piece if "&" not in piece else html_lib.escape(html_lib.unescape(piece), quote=False)))
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                places = open_at.get(name)
                if name not in INLINE or places and places[-1] < len(stack) - 1:
                    flush()
                if name == "a":
                    links = max(0, links - 1)
                if places and not (name in ("p", "li") and scopes and scopes[-1] > places[-1]):
                    cut(places[-1])
                continue
            if name in RAW:
                if name not in INLINE:
                    stop = re.compile(rf"</{name}\s*[^>]*>", re.IGNORECASE).search(source, at)
                    at = stop.end() if stop else n if name in RAW_TO_END else at
                continue
            if name == "br":
                text.append((len(marked), False, " "))
                continue
            if name == "a":
                links += 1
            raw = m[3] or m[6] or ""
            mark, label, good, part = (_look if len(raw) < 200 else _look.__wrapped__)(name, raw) if "=" in raw or "hidden" in raw else (0, name, False, False)
            if name in INLINE:
                if mark and name not in VOID and not raw.rstrip().endswith("/"):
                    outer = around.get(node, node)
                    marked.append((len(stack), mark == UNSEEN))
                    push(name, self._node(node, name, label, UNSEEN, False))
                    around[node] = outer
                continue
            if part and self.in_article[node]:
                mark = 0
            flush()
            if name in VOID:
                continue
            if name == "body":
                if not body_seen:
                    held = [s for s in stack if s[0] != "head"]
                    cut(0)
                    for s in held:
                        push(*s)
                body_seen = True
                continue
            if name == "html":
                continue
            ends = ENDS.get(name, _BREAKS_P)
            while stack and stack[-1][0] in ends:
                cut(len(stack) - 1)
            if stack and stack[-1][0] == "head" and name not in ("meta", "link", "base"):
                cut(len(stack) - 1)
            if name == "header" and not self.in_article[node]:
                mark = mark or BESIDE
            mark = max(mark, TAGS.get(name, 0))
            if name == "h1":
                self.signs[node] |= 2
            push(name, self._node(node, name, label, mark, good) if mark or name in CONTAINER else node)
        flush()

    def _left_out(self) -> list[bool]:
        """Whether each node is left out: it, or one above it, is marked and does not stay."""
        n, parents, marks = len(self.parents), self.parents, self.marks
        unseen = [False] * n
        for k in range(n):  # parents come before their children
            unseen[k] = marks[k] == UNSEEN or parents[k] >= 0 and unseen[parents[k]]
        own, long, signs = [0] * n, [0] * n, [0 if unseen[k] else self.signs[k] for k in range(n)]
        for k, text, linked in self.blocks:
            if not unseen[k] and (running := len(text) - 2 * linked) > 0:
                own[k] += running
                long[k] += running if running >= LONG_BLOCK else 0
        below, free = own.copy(), own.copy()  # all below a node, and what of it is not in another marked one
        inner: dict[int, list[int]] = defaultdict(list)
        nearest = [0] * n  # the marked node that a node stands in
        for k in range(1, n):
            nearest[k] = parents[k] if marks[parents[k]] or parents[k] == 0 else nearest[parents[k]]
            if marks[k]:
                inner[nearest[k]].append(k)
        for k in range(n - 1, 0, -1):
            up = parents[k]
            below[up] += below[k]
            long[up] += long[k]
            signs[up] |= signs[k] if marks[k] != REPLIES else signs[k] & 2
            if not marks[k]:
                free[up] += free[k]
        stays, seen = set(), free[0]
        heap = [(-below[k], k) for k in inner[0]]
        heapq.heapify(heap)
        while heap and -heap[0][0] > STAYS * seen:
            size, k = heapq.heappop(heap)
            if signs[k] & 2 or marks[k] != REPLIES and signs[k] or marks[k] == BESIDE and long[k] >= LONG_TEXT:
                stays.add(k)
                seen += free[k]
                for j in inner[k]:
                    heapq.heappush(heap, (-below[j], j))
        out = [False] * n
        for k in range(1, n):
            out[k] = out[parents[k]] or marks[k] > 0 and k not in stays
        return out

    def scores(self) -> list[float]:
        """Characters of running text below each node, those in links counted against it, by its weight."""
        total = [0.0] * len(self.parents)
        for k, text, linked in self.blocks:
            if not self.out[k]:
                total[k] += max(0, len(text) - 2 * linked)
        for k in range(len(total) - 1, 0, -1):  # children come after their parents
            total[self.parents[k]] += total[k]
        return [t * w for t, w in zip(total, self.weights, strict=True)]

    def votes(self) -> list[tuple[int, int, float]]:
        """(path, depth, vote) of the containers near the best one."""
        s = self.scores()
        best = max(s)
        found: dict[int, tuple[int, float]] = {}
        for k, x in enumerate(s):
            if best > 0 and x >= NEAR_BEST * best:
                found[self.paths[k]] = (self.depths[k], max(found.get(self.paths[k], (0, 0.0))[1], (x / best) ** 4))
        return [(p, d, v) for p, (d, v) in found.items()]

    def main_text(self, path: int | None) -> str:
        """Blocks of the containers on the path, or on that of the page's own best one, joined by newlines."""
        s = self.scores()
        own = max(range(len(s)), key=lambda k: (s[k], self.depths[k], -k))
        some = [k for k in range(len(s)) if self.paths[k] == path and s[k] > 0]
        if not some or max(s[k] for k in some) < SMALL_PART * s[own]:
            some = [k for k in range(len(s)) if self.paths[k] == self.paths[own] and s[k] > 0]
        top = max((s[k] for k in some), default=0)
        chosen = {k for k in some if not self.bare[k] or s[k] >= LIKE_PART * top} or {own}
        below = [False] * len(s)
        for k in range(len(s)):
            below[k] = k in chosen or self.parents[k] >= 0 and below[self.parents[k]]
        return "\n".join(t for k, t, _ in self.blocks if below[k] and not self.out[k])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the winning path of each host, by the votes of all its pages (ties: the deeper, then the
    larger hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for b in pieces(batches, 200):
            rows = [(h, *v) for h, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for v in Page(s).votes()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.float64()))], ["host", "path", "depth", "vote"])

    votes = pages.select(url_host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "host string, path long, depth int, vote double")
    sums = votes.groupBy("host", "path", "depth").agg(F.round(F.sum("vote"), 6).alias("votes"))
    return sums.groupBy("host").agg(F.max_by("path", F.struct("votes", "depth", "path")).alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    A null html is an empty page; a null url, or one without host, belongs to the host of the empty name. Blocks
    are joined by a newline, white space within one (and a line break) is one space; ``text`` is empty if
    there is none. Repeated rows vote each and give repeated rows; an empty table gives none; other columns
    are ignored.
    """
    winners = materialize(host_paths(pages).select(F.col("host").alias("page_host"), "path"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for b in pieces(batches, 200):
            texts = [Page(source).main_text(path) for source, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), url_host(F.col("url")).alias("page_host"))
    found = rows.join(F.broadcast(winners), "page_host", "left") if winners.count() <= BROADCAST_HOSTS else spread_join(rows, winners, ["page_host"], "left")
    return found.select("page_id", "url", "html", "path").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; see ``main_text`` for nulls, repeated rows and empty pages."""
    return main_text(read_table(spark, sf_dir, "pages"))
