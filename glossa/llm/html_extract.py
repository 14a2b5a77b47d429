"""Main text of web pages by consensus host paths.

Each page's containers are scored; Spark counts, host by host, how many pages elect which generalised tag-class path; then every
page is extracted again from the container that lies at a winning path of its host, or from its own best one where it has none.

Formulas (``math``, less their annotations) and the fallback text of ``object`` and ``noscript`` are text like any other; what is in scripts, styles, frames, text
fields, ``template``, ``svg`` and ``select`` is not.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, sized_join

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|(?P<loose>/?[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.DOTALL)
#: Every attribute is read, with its value, so that none begins inside of another's name or value.
_ATTR = re.compile(r"""([^\s"'>/=][^\s"'>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?|"[^"]*"|'[^']*'""")
_READ = frozenset("class id role style hidden aria-hidden itemprop".split())
#: Their content is no markup; without an end tag it reaches to the end of the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Content that isn't shown as text of the page; without an end tag only the tag is passed over.
SKIPPED = frozenset("template svg select annotation annotation-xml".split())
#: Containers that can be the article.
CONTAINERS = frozenset("html body main article section div td center blockquote fieldset details".split())
#: Subtrees that never belong to it.
OUT = frozenset("nav footer aside form button menu dialog header".split())
BLOCKS = CONTAINERS | OUT | frozenset("address dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr li ol p pre table tbody tfoot thead th tr ul br caption legend option summary head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SUB = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
JUNK = frozenset(
    "ad ads adbox adslot adunit advert adverts advertisement advertising banner banners sponsor sponsored promo promos promotion cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup share sharing shares social "
    "sidebar side widget widgets related recommended recommendations comment comments commentlist disqus respond reply replies breadcrumb breadcrumbs pagination pager menu nav navbar navigation toolbar masthead footer copyright login search skip alert "
    "toc outbrain taboola disclaimer teaser teasers trending popular form forms".split()
)
GOOD = frozenset("article content entry main post story text body".split())
#: Of these, what names layout as often as it names content; a subtree of such a class stays if it holds most of the running text.
LAYOUT = frozenset("sidebar side widget widgets overlay modal popup banner banners notice notices social share sharing shares menu nav navbar navigation toolbar masthead search form forms skip alert teaser teasers promo promos promotion toc".split())
#: A class that begins with a word of JUNK is junk only if the words after it are such, or those: related-posts is, related-work isn't.
COMPANIONS = frozenset(
    "a an and the of to for in on at by my our your post posts link links article articles story stories topic topics news product products list lists item items box boxes block blocks section sections container containers "
    "wrapper wrap inner outer holder bar bars left right top bottom main primary secondary tertiary area areas zone zones region button buttons btn icon icons content contents panel panels header head title heading text body message messages "
    "input field slot slots unit units space place placeholder frame site page pages global local mobile desktop sticky fixed floating float media email count counts counter meta info nav thread tree feed grid row col column columns card cards group groups set "
    "policy bg background image images img logo label labels tag tags level small large big mini wide up down open closed close toggle trigger new more first last author date view views module component element".split()
)
HIDDEN = frozenset("hidden is-hidden visually-hidden".split())
NEGATED = frozenset("no has with without is not hide".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
_DIGITS = re.compile(r"\d+")
#: A path wins in its host if at least this share of its pages elect it, so there are at most ten.
MIN_SHARE = 0.1
#: The path of a container deeper than this is a hash of its segment and the path around it, so that no path grows with the depth.
DEEPEST = 64


def _junk(attrs: dict[str, str], tag: str) -> str:
    """Why a subtree doesn't belong to the article: ``sure``, or by its class alone ``layout`` or ``named``; empty if it may."""
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower() or attrs.get("role", "").lower() in ROLES:
        return "sure"
    why = ""
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        sub = [x.lower() for x in _SUB.findall(name)]
        if not sub or sub[0] in NEGATED - {"is"} or tag in ("body", "html", "main"):
            continue
        if tag == "article" and sub[0] not in ("comment", "ad", "advert", "teaser", "related", "promo", "sponsored"):
            continue
        if name.lower() in HIDDEN:  # only by its whole name: overflow-hidden and hidden-xs are shown
            why = why or "layout"
        words = {sub[0]} if all(x in JUNK or x in COMPANIONS for x in sub[1:]) else set()
        if len(sub) < 2 or sub[-2] not in NEGATED:  # content-with-sidebar is none
            words.add(sub[-1])
        if sub[0] != "is" and (words := words & JUNK):
            if words - LAYOUT:
                return "named"
            why = "layout"
    return why


def _running(s: str, linked: int) -> bool:
    """Whether a block is running text."""
    return len(s) >= 25 and linked < 0.4 * len(s)


class Page:
    """Blocks of a page with their containers, by one scan of the tags."""

    __slots__ = ("blocks", "last", "parent", "paths", "weight")

    def __init__(self, html: str) -> None:
        self.paths, self.parent, self.weight, self.last = ["html"], [-1], [0.1], [0]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters in links
        stack: list[tuple[str, int, bool, int]] = []  # tag, container outside of it, whether what is outside counts, suspect outside of it
        open_: Counter[str] = Counter()  # how many of a tag are in the stack
        node, counts, link, linked, text, suspect = 0, True, 0, 0, [], 0
        suspects: list[tuple[int, str]] = [(-1, "")]  # subtrees that are junk by their class alone: the one outside, why
        within: list[int] = []  # the suspect of each block
        pos, n = 0, len(html)
        unended: set[str] = set()

        def flush() -> None:
            nonlocal linked
            if text:
                if s := " ".join("".join(text).split()):
                    self.blocks.append((node, s, linked))
                    within.append(suspect)
                text.clear()
            linked = 0

        while pos < n:
            m = None
            lt = html.find("<", pos)
            while lt >= 0 and not (m := _TAG.match(html, lt)):  # a bare < is text
                lt = html.find("<", lt + 1)
            end = lt if lt >= 0 else n
            if end > pos and counts:
                s = html[pos:end]
                if "&" in s:
                    s = _html.unescape(s)
                text.append(s)
                if link:
                    linked += len(s)
            if m is None:
                break
            pos = m.end()
            name = m["name"]
            if name is None:
                name = m["loose"]
                if name is None or not m[0].endswith(">"):  # a comment, a declaration, or a tag that the end cuts off
                    continue
                closing, rest = name.startswith("/"), m["attrs"]
                name = name.lstrip("/").lower()
            else:
                closing, rest, name = bool(m["close"]), m["rest"], name.lower()
            if name == "a":
                link = 0 if closing else 1
            if name not in BLOCKS:
                if not closing and (name in RAW or name in SKIPPED) and not rest.endswith("/") and name not in unended:
                    e = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, pos)
                    if not e:
                        unended.add(name)  # nor is there one further on
                    pos = e.end() if e else n if name in RAW else pos
                    text.append(" ")
                continue
            flush()
            if name in VOID:
                continue
            if closing:
                if not open_[name]:
                    continue
                while True:
                    new = stack.pop()
                    open_[new[0]] -= 1
                    if new[0] == name:
                        break
                while node != new[1]:
                    self.last[node] = len(self.paths) - 1
                    node = self.parent[node]
                counts, suspect, link = new[2], new[3], 0
                continue
            while stack and stack[-1][0] == "p":  # a block ends an open paragraph
                _, _, counts, suspect = stack.pop()
                open_["p"] -= 1
            container = name in CONTAINERS
            if name == "html" or (name == "body" and open_["body"]):
                continue
            attrs: dict[str, str] = {}
            for k, a, b, c in _ATTR.findall(rest) if rest and not rest.isspace() else ():
                if (k := k.lower()) in _READ:
                    attrs.setdefault(k, a or b or c or "")
            why = _junk(attrs, name) if attrs else ""
            out = (name in OUT and (name != "header" or not (open_["article"] or open_["main"]))) or why == "sure"
            if not container and not out and not why:
                continue  # paragraphs and the like only part blocks
            stack.append((name, node, counts, suspect))
            open_[name] += 1
            if out:
                counts = False
            elif why and counts:
                suspects.append((suspect, why))
                suspect = len(suspects) - 1
            if container and counts:
                classes = sorted({_DIGITS.sub("#", x.lower()) for x in attrs.get("class", "").split()})
                sub = {x.lower() for x in _SUB.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")}
                good = name in ("article", "main") or attrs.get("role", "") in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody"
                path = f"{self.paths[node]}>{name}" + "".join(f".{x}" for x in classes)
                self.paths.append(path if len(stack) <= DEEPEST else "#" + hashlib.md5(path.encode("utf-8", "surrogatepass")).hexdigest())
                self.parent.append(node)
                self.weight.append({"article": 2.0, "main": 1.7}.get(name, 1.7) if good else 1.5 if sub & GOOD and name != "body" else 0.6 if name == "body" else 1.0)
                self.last.append(0)
                node = len(self.paths) - 1
        flush()
        while node >= 0:
            self.last[node] = len(self.paths) - 1
            node = self.parent[node]
        if any(within):
            self._drop(suspects, within)

    def _drop(self, suspects: list[tuple[int, str]], within: list[int]) -> None:
        """Drop the blocks in suspects, less those that are wrappers of the article.

        Each is held against its scope, the page or the suspect named by its content that it lies in, without what is in other such ones: layout stays if it
        holds most of the scope's text, of the others the largest stays if the scope has no text but theirs. Text is running text, and all of marked containers.
        """
        n = len(suspects)
        marked = [False] * len(self.paths)
        for i in range(1, len(marked)):
            marked[i] = self.weight[i] >= 1.5 or marked[self.parent[i]]
        total, scope = [0] * n, [0] * n
        for (c, s, linked), i in zip(self.blocks, within, strict=True):
            total[i] += len(s) * (_running(s, linked) or marked[c])
        rest = total[:]
        for i in range(n - 1, 0, -1):
            outside, why = suspects[i]
            total[outside] += total[i]
            if why == "layout":
                rest[outside] += rest[i]
        for i in range(1, n):
            outside = suspects[i][0]
            scope[i] = outside if not outside or suspects[outside][1] == "named" else scope[outside]
        largest: dict[int, int] = {}
        for i in range(1, n):
            if suspects[i][1] == "named" and total[i] > total[largest.get(scope[i], 0)] * (scope[i] in largest):
                largest[scope[i]] = i
        stays = [True] * n
        for i in range(1, n):
            outside, why = suspects[i]
            all_ = rest[scope[i]]
            own = 2 * rest[i] > all_ if why == "layout" and all_ else not all_ and (why == "layout" and total[i] > 0 or largest.get(scope[i]) == i)
            stays[i] = stays[outside] and own
        self.blocks = [b for b, i in zip(self.blocks, within, strict=True) if stays[i]]

    def _sums(self, of: Callable[[str, int], float]) -> list[float]:
        """The sum of what each container's blocks count for."""
        own = [0.0] * len(self.paths)
        for c, s, linked in self.blocks:
            own[c] += of(s, linked)
        for i in range(len(own) - 1, 0, -1):
            own[self.parent[i]] += own[i]
        return own

    def scores(self) -> list[float]:
        """Characters of running text in each container, linked blocks counting against it, times its tag's weight; none is negative."""
        own = self._sums(lambda s, linked: len(s) if _running(s, linked) else -0.3 * min(len(s), 80) if linked >= 0.4 * len(s) else 0)
        return [max(0.0, x) * w for x, w in zip(own, self.weight, strict=True)]

    def best(self, paths: set[str] | None = None) -> int:
        """The container of the highest score, among those at the given paths if there are any; -1 if none has text.

        Only containers with text count. Of equals it is the innermost, but where nothing runs the one with most text outside of links, then with
        most text, by its tag's weight. Without a path it gives way to a container around it that holds more by that measure, unless what that adds is
        a list of links or under 25 characters.
        """
        if not self.blocks:
            return -1
        s, total = self.scores(), self._sums(lambda s, linked: len(s))
        free = self._sums(lambda s, linked: len(s) if linked < 0.4 * len(s) else 0)
        full = [i for i, n in enumerate(total) if n]
        weight = [max(0.6, w) for w in self.weight]  # a page need not have a body tag
        mass = [n * w for n, w in zip(free, weight, strict=True)]

        def key(i: int) -> tuple[float, ...]:
            return (s[i], 0, 0, i) if s[i] > 0 else (0, mass[i], total[i] * weight[i], i)

        top = self._widened(max(full, key=key), total, free, mass)
        if paths:
            at = [i for i in full if self.paths[i] in paths]
            if at:
                own = max(at, key=key)
                if s[own] >= 0.5 * s[top] and mass[own] >= 0.5 * mass[top]:  # a path the host elected, but not where this page keeps its text elsewhere
                    top = own
        return top

    def _widened(self, top: int, total: list[float], free: list[float], mass: list[float]) -> int:
        up = self.parent[top]
        while up >= 0:
            added = total[up] - total[top]
            if added >= 25:
                if free[up] - free[top] <= 0.6 * added:
                    break
                if mass[up] > mass[top]:
                    top = up
            up = self.parent[up]
        return top

    def text(self, container: int) -> str:
        if container < 0:
            return ""
        return " ".join(s for c, s, _ in self.blocks if container <= c <= self.last[container])


def extract_one(html: str | None, paths: list[str] | None = None) -> str:
    """The main text of one page, given the winning paths of its host."""
    if not html:
        return ""
    page = Page(html)
    return page.text(page.best(set(paths or ())))


def host_of(url):
    """The lower-case host of a URL column; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def elect(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, paths: what wins in each host. Votes are summed before they are shuffled, one row a host, path and task."""
    ship(pages.sparkSession)

    def vote(batches):
        for b in batches:
            paths = []
            for h in b.column(1).to_pylist():
                page = Page(h) if h else None
                at = page.best() if page else -1
                paths.append(page.paths[at] if at >= 0 else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string())], names=["host", "path"])

    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col)).mapInArrow(vote, "host string, path string").where("path IS NOT NULL")
    votes = votes.groupBy("host", "path").count()
    share = votes.join(votes.groupBy("host").agg(F.sum("count").alias("pages")), "host").where(F.col("count") >= MIN_SHARE * F.col("pages"))
    return share.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("paths"))  # at most 1 / MIN_SHARE of them


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row.

    Null or empty html gives an empty text, a null url belongs to the host ''. Rows that repeat an id are extracted each by itself (and
    vote each). Other columns aren't read; an empty table gives an empty result. The elected paths are broadcast when few (their
    number is counted), else joined by host with salts; the pages are shuffled only in that case.
    """
    ship(pages.sparkSession)
    winners = materialize(elect(pages, url_col, html_col), "paths")
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [extract_one(h, w) for h, w in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return sized_join(p, winners, "host", row_bytes=1024).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
