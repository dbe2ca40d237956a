"""Main-text extraction with a site style tree.

The pages of a host are merged into one tree: a node is an element reached by the same path of
tags and classes, and holds how often each presentation (sequence of child elements) and each
content (text of the branch) occurs. A node's importance is one part the entropy of its
presentations and nine parts how far its contents differ from page to page: a text that all
occurrences share has entropy 1 and importance 0, a text of one page importance 1. Copies of a
page count once. The tree is kept as counts per (host, path, presentation or content), which Spark
aggregates, so no host's pages meet in one task. A container branch of low importance is removed
from the pages on which its content is one of the frequent ones there, unless it holds most of the
page's article; and so are elements whose tag, class, id or role names them as menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles or reader comments. A class or id does so by a whole token
that consists of such names and words of place or kind (``site-header``, not ``has-sidebar``), never on html,
body, main, article or an element around the page's largest article; a form around that article, or with most
of its text, is none either. What is left of the page's article (else its main element, else its
body) is the text.
"""

from __future__ import annotations

import html as entities
import re
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washkit.llm.common import digest, stored
from washkit.llm.url_reputation import host_and_path

#: Occurrences from which a node's importance is trusted, and the importance below which a branch goes.
MIN_SEEN, LOW = 8, 0.1
#: Share of a node's occurrences (and MIN_SEEN of them) from which a content is a frequent one.
FREQUENT = 0.01

# Names of HTML elements and of the parts of a page that are not its article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
NOISE_TAGS = frozenset("head nav header footer aside script style noscript template iframe button select textarea svg dialog menu object canvas audio video".split())
NOISE_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
                        "sidebar aside notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login search comment comments disqus "
                        "social share sharing related recommended widget toolbar pagination".split())
#: Words that may stand beside a noise name in a class or id token.
PLACES = frozenset("site page main top bottom left right primary secondary global mobile desktop fixed sticky inner outer list box bar block wrap wrapper container section area row item items link links post posts icon icons button form 1 2 3".split())
#: Elements that a name never makes noise.
ROOTS = frozenset("html body main article".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CONTAINERS = frozenset("div section ul ol dl table figure details center fieldset".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}

_TOKEN = re.compile(
    r"(?P<raw><(?P<rawname>script|style|noscript|template|textarea|iframe|title)\b[^>]*>(?:.*?</(?P=rawname)\s*>|.*))"
    r"|(?P<gone><!--.*?(?:-->|\Z)|<[!?][^>]*>)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*|[^>]*)>"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|$)", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


def _code(*parts) -> int:
    return int.from_bytes(blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def names_noise(value: str) -> bool:
    """Whether a whole token of a class or id names an element as noise."""
    for token in value.split():
        parts = [x for x in _PARTS.split(token) if x]
        if not NOISE_NAMES.isdisjoint(parts) and all(x in NOISE_NAMES or x in PLACES for x in parts):
            return True
    return False


class Page:
    """Block elements of a page (path, parent, tag, whether noise) and its blocks of text in order."""

    def __init__(self, text: str, paths: dict | None = None):
        self.paths = {} if paths is None else paths
        self.tag, self.path, self.parent, self.kids = ["#"], [0], [-1], [[]]
        self.own = [0]  # 1: named as noise, or a form; 2: noise by its tag
        self.parts: list[list] = [[]]  # of an element, in order: its texts, and its child elements' numbers
        self.blocks: list[tuple[str, int]] = []
        stack: list[tuple[str, int, bool]] = []  # (tag, block element, whether inside an inline element that is noise)
        buf: list[str] = []
        node, noisy = 0, False

        def flush():
            if buf:
                t = "".join(buf)
                t = " ".join((entities.unescape(t) if "&" in t else t).split())
                buf.clear()
                if t:
                    self.blocks.append((t, node))
                    self.parts[node].append(t)

        for m in _TOKEN.finditer(text):
            kind = m.lastgroup
            if kind == "text":
                if not noisy:
                    buf.append(m.group())
                continue
            if kind in ("gone", "raw", "rawname"):
                continue
            name = m["name"].lower()
            if m["end"]:
                if name == "br":
                    buf.append(" ")
                    continue
                at = len(stack) - 1
                while at >= 0 and stack[at][0] != name:
                    if name in INLINE and stack[at][0] not in INLINE:
                        at = -1
                        break
                    at -= 1
                if at < 0:
                    continue
                if name not in INLINE:
                    flush()
                del stack[at:]
            elif name in VOID:
                if name == "br":
                    buf.append(" ")
                elif name == "hr":
                    flush()
                continue
            else:
                if name not in INLINE:
                    flush()
                    close = SIBLINGS.get(name, ())
                    for at in range(len(stack) - 1, -1, -1):
                        t = stack[at][0]
                        if t in CLOSED_BY_BLOCK or t in close:
                            del stack[at:]
                            if not close or t in CLOSED_BY_BLOCK:
                                continue
                        if t not in INLINE and t not in close and t not in CLOSED_BY_BLOCK:
                            break
                    node, noisy = (stack[-1][1], stack[-1][2]) if stack else (0, False)
                classes, bad = self._attrs(m["attrs"]) if m["attrs"] else ("", False)
                if name in INLINE:
                    stack.append((name, node, noisy or bad))
                else:
                    key = (self.path[node], name, classes)
                    path = self.paths.get(key)
                    if path is None:
                        path = self.paths[key] = _code(*key)
                    self.kids[node].append(name)
                    self.parts[node].append(len(self.tag))
                    self.tag.append(name)
                    self.path.append(path)
                    self.parent.append(node)
                    self.own.append(2 if name in NOISE_TAGS else 1 if bad or noisy or name == "form" else 0)
                    self.kids.append([])
                    self.parts.append([])
                    stack.append((name, len(self.tag) - 1, False))
            node, noisy = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        flush()
        self._settle()

    @staticmethod
    def _attrs(attrs: str) -> tuple[str, bool]:
        """(classes, whether a name in them is one of noise)."""
        classes, bad = "", False
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "class":
                classes = value
            if name in ("class", "id"):
                bad = bad or names_noise(value)
            elif name == "role":
                bad = bad or value.strip() in NOISE_ROLES
            elif name == "hidden":
                bad = True
            else:
                bad = bad or value == "true"
        return classes, bad

    def _sizes(self, counts) -> list[int]:
        """Characters of the blocks that count, in and below every element."""
        size = [0] * len(self.tag)
        for t, i in self.blocks:
            if counts(i):
                size[i] += len(t)
        for i in range(len(size) - 1, 0, -1):
            size[self.parent[i]] += size[i]
        return size

    def _settle(self) -> None:
        """Which elements are noise, known when the page's largest article is."""
        n = len(self.tag)
        hard = [False] * n
        for i in range(1, n):
            hard[i] = self.own[i] == 2 or hard[self.parent[i]]
        size = self._sizes(lambda i: not hard[i])
        roots = next((found for tag in ("article", "main") if (found := [i for i in range(1, n) if self.tag[i] == tag and not hard[i]])), [])
        around, i = set(), max(roots, key=lambda i: (size[i], -i), default=0)
        most = size[i]
        while i > 0:
            around.add(i)
            i = self.parent[i]
        self.noise = [False] * n
        for i in range(1, n):
            soft = self.own[i] == 1 and i not in around and self.tag[i] not in ROOTS and not (self.tag[i] == "form" and 2 * size[i] > most)
            self.noise[i] = self.noise[self.parent[i]] or self.own[i] == 2 or soft

    def contents(self) -> list[int | None]:
        """A code of the text in and below every block element, none where there is no text. An
        element's code comes from its own texts and its children's codes, so a deep page costs no more."""
        out: list[int | None] = [None] * len(self.tag)
        for i in range(len(out) - 1, -1, -1):
            found = [x if isinstance(x, str) else out[x] for x in self.parts[i] if isinstance(x, str) or out[x] is not None]
            if found:
                out[i] = found[0] if len(found) == 1 and isinstance(found[0], int) else _code(*found)
        return out

    def counted(self):
        """(path, presentation, content) of every block element with text below it."""
        for n, content in enumerate(self.contents()):
            if n and content is not None:
                yield self.path[n], _code(*self.kids[n]), content

    def main_text(self, low: frozenset[tuple[int, int]] | set[tuple[int, int]] = frozenset()) -> str:
        """Blocks of the article outside noise and outside container branches with a (path, content)
        in ``low``; a branch with more than half of the article's characters stays."""
        n = len(self.tag)
        inside: list[str] = [""] * n  # the kind of root that the element is in
        holds = [False] * n
        for i in range(1, n):
            inside[i] = inside[self.parent[i]]
            if not self.noise[i] and self.tag[i] in ("article", "main") and inside[i] != "article":
                inside[i] = self.tag[i]
                j = i
                while j >= 0 and not holds[j]:
                    holds[j] = True
                    j = self.parent[j]
        root = next((r for r in ("article", "main") if r in inside), None)
        gone = list(self.noise)
        paths = {p for p, _ in low}
        known = [i for i in range(1, n) if self.path[i] in paths and not holds[i] and self.tag[i] in CONTAINERS]
        if known:
            contents = self.contents()
            size = self._sizes(lambda i: not self.noise[i] and (root is None or inside[i] == root))
            for i in known:
                gone[i] = gone[i] or (2 * size[i] <= size[0] and (self.path[i], contents[i]) in low)
        for i in range(1, n):
            gone[i] = gone[i] or gone[self.parent[i]]
        return "\n".join(t for t, i in self.blocks if not gone[i] and (root is None or inside[i] == root))


def _counted(batches):
    import pyarrow as pa

    for b in batches:
        paths: dict = {}
        rows: dict = {}
        for host, key, html in zip(*(b.column(c).to_pylist() for c in ("host", "key", "html")), strict=True):
            if (host, key) not in rows:
                rows[host, key] = list(zip(*Page(html, paths).counted(), strict=True)) or [(), (), ()]
        hosts, keys = zip(*rows, strict=True) if rows else ((), ())
        cols = zip(*rows.values(), strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.binary()), *(pa.array(c, pa.list_(pa.int64())) for c in cols)],
                                         names=["host", "key", "paths", "styles", "contents"])


def style_tree(pages: DataFrame, min_seen: int = MIN_SEEN) -> tuple[DataFrame, DataFrame]:
    """The merged element nodes of ``pages`` (host, html): (host, path, seen, importance), and how often
    each content occurs at them: (host, path, value, c). Copies of a page on a host count once."""
    once = pages.select("host", digest("html").alias("key"), "html") \
        .mapInArrow(_counted, "host string, key binary, paths array<bigint>, styles array<bigint>, contents array<bigint>").dropDuplicates(["host", "key"])
    nodes = once.select("host", F.explode(F.arrays_zip("paths", "styles", "contents")).alias("x"))
    counts = nodes.select("host", F.col("x.paths").alias("path"), F.posexplode(F.array("x.styles", "x.contents")).alias("kind", "value")) \
        .groupBy("host", "path", "kind", "value").agg(F.count("*").alias("c"))
    counts = stored(counts, "styles")
    sums = counts.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("c"))).alias("seen"),
        F.sum(F.when(F.col("kind") == 0, F.col("c") * F.log("c"))).alias("styles"), F.sum(F.when(F.col("kind") == 1, F.col("c") * F.log("c"))).alias("contents"))
    same = lambda c: F.when(F.col("seen") > 1, F.col(c) / (F.col("seen") * F.log("seen"))).otherwise(F.lit(0.0))
    nodes = sums.select("host", "path", "seen", (0.1 * (1 - same("styles")) + 0.9 * (1 - same("contents"))).alias("importance"))
    return nodes, counts.where((F.col("kind") == 1) & (F.col("c") >= min_seen)).select("host", "path", "value", "c")


def _extracted(batches):
    import pyarrow as pa

    for b in batches:
        paths: dict = {}
        texts = [Page(html, paths).main_text(frozenset(zip(low[::2], low[1::2], strict=True)) if low else frozenset()) for html, low in zip(b.column("html").to_pylist(), b.column("low").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_seen: int = MIN_SEEN, low: float = LOW) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    Character references are decoded, white space inside a block becomes one space, blocks are
    trimmed and joined by a line feed; n_chars counts code points. Null html and pages without
    article text give an empty text. A null URL stays null; such pages share the empty host.
    Null and repeated ids are rows like any other. Other columns are not read.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host_and_path(F.col(url_col))[0].alias("host"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    nodes, contents = style_tree(base, min_seen)
    unimportant = nodes.where((F.col("seen") >= min_seen) & (F.col("importance") < low))
    frequent = contents.join(unimportant, ["host", "path"]).where(F.col("c") >= F.col("seen") * FREQUENT)  # at most 1 / FREQUENT a node
    branches = stored(frequent.groupBy("host").agg(F.flatten(F.collect_list(F.array("path", "value"))).alias("low")), "branches")
    return base.join(branches, "host", "left").select("page_id", "url", "html", "low").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
