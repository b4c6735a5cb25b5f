"""HTML extraction by nearest-URL page differencing.

Each page becomes a list of text lines, one per block. Pages are put in order of host and path; a page is
compared with that neighbour of its host whose path shares more leading parts. Their lines are aligned by
longest common subsequence and shared lines go, being the site's and not the page's; copies of a page are no
neighbours of it. Of what a page itself marks as its article a shared line goes only if other pages of the host
share it with their neighbours too; what it marks as menu, header, footer, sidebar, notice, advert, form or
comment is never text.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import number_rows
from ..operators.joins import fits_broadcast
from ..session import stage
from .common import table
from .graph import components
from .registry import query
from .url_filters import host_of, path_of

# Fixed values of HTML: elements whose content is no text, that start a block, that stand alone, and that
# hold what is not the article; words in a class, an id or a role that say the same.
_RAW = ("script", "style", "noscript", "template", "svg", "textarea", "iframe", "object")
_OPEN_RAW = ("script", "style")     # without an end tag these go on to the end of the page; the others hold nothing
_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody
    td tfoot th thead title tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SIDE = frozenset("head title nav header footer aside form menu button select dialog label search".split())
_MARKED = re.compile(r"""(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo|banner|cookies?|consent|notices?|nav|
    navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|widget|footer|header|masthead|comments?|replies|disqus|share|sharing|
    social|related|recommended|newsletter|subscribe|subscription|signup|login|popup|modal|overlay|toolbar|pagination|pager|
    search|complementary|contentinfo)(?:$|[\s_\d-])""", re.X | re.I)
_MAIN = re.compile(r"(?:^|[\s_-])(?:main|article(?:-?body)?|articleBody|post-?(?:body|content)|entry-?content)(?:$|[\s_-])", re.I)
# class words that say what a wrapper has or has not, and an article's own header
_STATE = re.compile(r"(?<![^\s])(?:has|have|with|without|no)[-_][^\s]*", re.I)
_HEAD = re.compile(r"(?<![^\s])(?:article|post|entry|story)(?:[-_]+|(?=H))header(?![^\s])", re.I)
_HOLDS = re.compile(r"</form\b|<(?:h1|main|article)\b", re.I)
# inside an article only an element whose class as a whole names what is beside it is left out
_INSIDE = re.compile(r"""(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo|banner|cookies?|consent|notices?|nav|navbar|navigation|menu|
    breadcrumbs?|sidebar|aside|widget|footer|comments?|replies|disqus|share|sharing|social|related|recommended|newsletter|subscribe|
    subscription|signup|login|popup|modal|overlay|toolbar|pagination|pager|search|complementary|contentinfo)
    (?:[-_]*(?:list|box|signup|bar|area|section|form|links?|buttons?|icons?|block|unit|slot|container|wrap(?:per)?|thread|posts|articles|menu|\d+))?""", re.X | re.I)
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class _Markup:
    """Where the comments, tags and raw elements of a page end, in time in proportion to the page however broken it is."""

    def __init__(self, page: str):
        self.page, self.quoted, self.open = page, True, True
        self.unclosed: set[str] = set()     # quotes and raw elements that are not closed from some place on

    def tag(self, at: int) -> tuple[int, str, str, str] | None:
        """(end, slash, name, attributes) of the tag at ``at``; without a name for comments and declarations; None
        if it is text. A ``>`` in quotes does not end a tag, unless some tag would then have no end at all."""
        page = self.page
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return (end + 3 if end >= 0 else len(page)), "", "", ""
        if page[at + 1:at + 2] in ("!", "?"):
            end = page.find(">", at)
            return (end + 1 if end >= 0 else len(page)), "", "", ""
        m = _NAME.match(page, at) if self.open else None
        if not m:
            return None
        end = self._end(m.end())
        if end < 0:
            self.open = False       # no > is left on the page
            return None
        return end + 1, m[1], m[2].lower(), page[m.end():end]

    def _end(self, at: int) -> int:
        page, start = self.page, at
        while self.quoted:
            m = _STOP.search(page, at)
            if not m:
                self.quoted = False
                break
            if m[0] == ">":
                return m.start()
            at = m.end()
            if m[0] not in self.unclosed:
                close = page.find(m[0], at)
                if close < 0:
                    self.unclosed.add(m[0])
                else:
                    at = close + 1
        return page.find(">", start)

    def raw_end(self, name: str, at: int) -> int:
        """The end of a raw element's content that begins at ``at``."""
        if name not in self.unclosed:
            for m in re.compile(rf"</{name}(?![^\s/>])", re.I).finditer(self.page, at):
                end = self.page.find(">", m.end())
                if end >= 0:
                    return end + 1
                break
            self.unclosed.add(name)
        return len(self.page) if name in _OPEN_RAW else at


def _role(tag: str, attrs: str, inside: bool = False) -> int:
    """1 for the page's article, -1 for what is beside it, -2 for what no article inside it lifts, 0 for neither.
    ``inside``: the element stands in the article."""
    found = 0
    if tag in _SIDE:
        found = -2
    elif tag in ("article", "main"):
        found = 1
    if attrs and tag not in ("html", "body"):
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                return -2
            if name in ("class", "id", "role", "itemprop") and value:
                plain = _HEAD.sub(" ", _STATE.sub(" ", value))
                if any(map(_INSIDE.fullmatch, plain.split())) if inside else _MARKED.search(plain):
                    found = min(found, -1) if found < 0 else -1
                elif _MAIN.search(plain) or _HEAD.search(value):
                    found = found or 1
    return found


def blocks(page: str) -> list[tuple[int, str]]:
    """(role, text) of a page's blocks in order. A header inside the article belongs to it.

    A form that holds a main heading or an article is the page's frame. A wrapper whose class alone puts it
    beside the article gives up an ``<article>`` or ``<main>`` inside, unless the page has an article elsewhere
    or more words outside of all that is marked.
    """
    out: list[tuple[int, int, str]] = []
    stack: list[tuple[str, int, int]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    role, lifted, at, frames, held = 0, 0, 0, True, None

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((role, lifted, text))
        parts.clear()

    def close(names: tuple[str, ...], stop: frozenset) -> None:
        nonlocal role, lifted
        if not any(opened[x] for x in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                flush()
                opened.subtract(x for x, _, _ in stack[i:])
                del stack[i:]
                role, lifted = stack[-1][1:] if stack else (0, 0)
                return
            if stack[i][0] in stop:
                return

    n, markup = len(page), _Markup(page)
    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            parts.append(page[at:])
            break
        if cut > at:
            parts.append(page[at:cut])
        token = markup.tag(cut)
        if not token:
            parts.append("<")
            at = cut + 1
            continue
        at, slash, tag, attrs = token
        if not tag:
            continue
        if slash:
            if tag in _BLOCK:
                close((tag,), frozenset())
                if tag == "p":
                    flush()
            elif tag == "br":
                parts.append(" ")
            else:       # an inline element is on the stack only with a role of its own
                close((tag,), _BLOCK)
            continue
        if tag == "svg" and attrs.endswith("/"):
            continue
        if tag in _RAW:
            at = markup.raw_end(tag, at)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in _BLOCK:
            close(("p",), _BLOCK - {"p"})
            if tag in _CLOSES:
                close(_CLOSES[tag], frozenset(("ul", "ol", "menu", "dl", "table")))
            flush()
        if tag in _VOID or attrs.endswith("/"):
            continue
        own = _role(tag, attrs, role > 0)
        if own < 0 and tag in ("header", "label") and role > 0 and not _MARKED.search(attrs.replace("=", " ").replace('"', " ")):
            own = 0
        if tag == "form" and own < 0 and frames and not _role("div", attrs):
            if held is None or held.start() < at:
                held = _HOLDS.search(page, at)
            frames = held is not None     # none further on either
            if held and held[0][1] != "/":
                own = 0
        if tag in _BLOCK or own:
            if own and tag not in _BLOCK and own != role:
                flush()
            anew = 1 if tag in ("article", "main") and own > 0 and lifted == -1 else lifted if lifted < 0 else own or lifted
            stack.append((tag, role if role < 0 else own or role, anew))
            opened[tag] += 1
            role, lifted = stack[-1][1:]
    flush()
    if all(r <= 0 for r, _, _ in out):
        inside = sum(len(t.split()) for _, x, t in out if x > 0)
        if inside > sum(len(t.split()) for r, _, t in out if r == 0):
            return [(max(x, -1), t) for _, x, t in out]
    return [(max(r, -1), t) for r, _, t in out]


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Flags of ``a``'s entries in a longest common subsequence of both; memory follows len(a) + len(b)."""
    flags = np.zeros(len(a), dtype=bool)
    todo = [(0, len(a), 0, len(b))]

    def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        row = np.zeros(len(y) + 1, dtype=np.int64)
        for v in x:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == v)))
        return row

    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            flags[i] = True
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            flags[j - 1] = True
            j, m = j - 1, m - 1
        if i == j or k == m:
            continue
        if j - i == 1:
            flags[i] = bool((b[k:m] == a[i]).any())
            continue
        mid = (i + j) // 2
        head, tail = lengths(a[i:mid], b[k:m]), lengths(a[i:j][mid - i:][::-1], b[k:m][::-1])[::-1]
        split = k + int(np.argmax(head + tail))
        todo += [(i, mid, k, split), (mid, j, split, m)]
    return flags


COPY = 0.9         # share of a page's words from which on a neighbour that has them is its copy
SITE, SHARE = 3, 0.5   # least number, and share of a host's pages, whose articles hold a line that is the site's
_LINES = "struct<lines:array<struct<role:int,line:string>>,hashes:array<bigint>,sizes:array<int>,key:bigint>"


def lines_of(page: Column) -> Column:
    """struct(lines, hashes, sizes, key): a page's blocks but those beside the article, a hash and the number of
    words of each, and a hash of them all."""
    @F.arrow_udf(_LINES)
    def lines(pages: pa.Array) -> pa.Array:
        found = [[b for b in blocks(x.as_py() or "") if b[0] >= 0] for x in pages]
        rows = pa.array([[{"role": r, "line": t} for r, t in page] for page in found],
                        pa.list_(pa.struct([("role", pa.int32()), ("line", pa.string())])))
        each = [[xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for _, t in page] for page in found]
        whole = [xxhash.xxh3_64_intdigest(np.array([[r, h] for (r, _), h in zip(p, e)], dtype=np.int64).tobytes()) - (1 << 63)
                 for p, e in zip(found, each)]
        return pa.StructArray.from_arrays(
            [rows, pa.array(each, pa.list_(pa.int64())), pa.array([[len(t.split()) for _, t in p] for p in found], pa.list_(pa.int32())),
             pa.array(whole, pa.int64())], ["lines", "hashes", "sizes", "key"])
    return lines(page)


def _array(x: pa.Scalar) -> np.ndarray:
    return np.array(x.as_py() or [], dtype=np.int64)


def difference(hashes: Column, other: Column) -> Column:
    """Per line of a page, whether ``other`` (a neighbour's hashes, null for none) shares it in order."""
    @F.arrow_udf("array<boolean>")
    def same(pages: pa.Array, others: pa.Array) -> pa.Array:
        return pa.array([shared(_array(p), _array(o)).tolist() for p, o in zip(pages, others)], pa.list_(pa.bool_()))
    return same(hashes, other)


def copies(hashes: Column, sizes: Column, other: Column, other_sizes: Column) -> Column:
    """Whether two pages share, in order, nearly all words of the shorter one."""
    @F.arrow_udf("boolean")
    def near(p: pa.Array, m: pa.Array, q: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for a, x, b, y in zip(*(map(_array, c) for c in (p, m, q, n))):
            least = COPY * min(x.sum(), y.sum())
            out.append(bool(x[np.isin(a, b)].sum() >= least and x[shared(a, b)].sum() >= least))
        return pa.array(out, pa.bool_())
    return near(hashes, sizes, other, other_sizes)


def _joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n")


def _together(a: Column, b: Column) -> Column:
    """How many leading parts two paths share."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
    return F.when(F.forall(same, lambda s: s), F.size(same)).otherwise(F.array_position(same, False) - 1)


def _ordered(rows: DataFrame) -> DataFrame:
    """(host, key, at, hashes, sizes, roles, path): each different page of a host once, numbered by host and path."""
    found = rows.where("host <> '' AND size(hashes) > 0").select(
        "host", "path", "url", "key", "hashes", "sizes", F.transform("lines", lambda x: x["role"]).alias("roles"))
    first = F.min(F.struct("path", "url", "hashes", "sizes", "roles")).alias("p")
    once = found.groupBy("host", "key").agg(first).select("host", "key", "p.*")
    return stage(number_rows(once, ["host", "path", "url", "key"], "at"), "ordered")


def _runs(placed: DataFrame) -> DataFrame:
    """(at, first, last): the places of the copies of one page that stand together, for pages that have some."""
    after = placed.select((F.col("at") - 1).alias("at"), F.col("host").alias("nh"), F.col("hashes").alias("nl"), F.col("sizes").alias("ns"))
    near = placed.join(after, "at").where("host = nh").withColumn("near", copies(F.col("hashes"), F.col("sizes"), F.col("nl"), F.col("ns")))
    edges = stage(near.where("near").select(F.col("at").alias("a"), (F.col("at") + 1).alias("b")), "copies")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("at"), F.col("a").alias("first"), F.col("b").alias("last"))
    parts = stage(components(edges), "copy-runs")
    ends = parts.groupBy("root").agg(F.max("node").alias("last"))
    return parts.join(ends, "root").select(F.col("node").alias("at"), F.col("root").alias("first"), "last")


def _differenced(placed: DataFrame) -> DataFrame:
    """(host, key, hashes, roles, first, same): the lines that the nearest page shares that is no copy."""
    runs = placed.join(_runs(placed), "at", "left").withColumns(
        {"first": F.coalesce("first", "at"), "last": F.coalesce("last", "at")})
    near = placed.select("host", "path", "hashes", "at")
    before = near.select((F.col("at") + 1).alias("first"), F.col("host").alias("bh"), F.col("path").alias("bp"), F.col("hashes").alias("bl"))
    after = near.select((F.col("at") - 1).alias("last"), F.col("host").alias("ah"), F.col("path").alias("ap"), F.col("hashes").alias("al"))
    both = runs.join(before, "first", "left").join(after, "last", "left")
    nb = F.when(F.col("bh") == F.col("host"), _together(F.col("path"), F.col("bp"))).otherwise(-1)
    na = F.when(F.col("ah") == F.col("host"), _together(F.col("path"), F.col("ap"))).otherwise(-1)
    other = F.when((nb < 0) & (na < 0), None).when(nb >= na, F.col("bl")).otherwise(F.col("al"))
    return stage(both.select("host", "key", "hashes", "roles", "first", difference(F.col("hashes"), other).alias("same")), "differenced")


def _site_lines(pages: DataFrame) -> DataFrame:
    """(host, key, site): the hashes of a page's article lines that are the site's. A neighbour shares them, and so
    it is with at least ``SITE`` pages and half the pages of the host, copies together counting once."""
    lines = F.filter(F.arrays_zip("hashes", "roles", "same"), lambda x: (x["roles"] > 0) & x["same"])
    each = pages.select("host", "key", "first", F.explode(F.array_distinct(F.transform(lines, lambda x: x["hashes"]))).alias("line"))
    each = stage(each, "shared-lines")
    site = (each.select("host", "line", "first").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= SITE))
    of = pages.select("host", "first").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    site = site.join(of, "host").where(F.col("n") >= SHARE * F.col("of")).select("host", "line")
    return each.join(site, ["host", "line"]).groupBy("host", "key").agg(F.collect_set("line").alias("site"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) per row of ``pages`` (page_id, url, html; the rest stays out).

    Null html is an empty page with empty text. Pages whose url is null or has no host have no neighbour and
    lose nothing to one. Repeated rows are pages of their own with one text. A copy is no neighbour: a page is
    compared with the nearest one that has less than nine tenths of its words.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                        lines_of(F.col("html")).alias("l")).select("page_id", "url", "host", "path", "l.*")
    rows = stage(rows, "pages", codec="zstd")
    found = _differenced(_ordered(rows))
    found = found.join(_site_lines(found), ["host", "key"], "left")
    marked = F.exists("roles", lambda r: r > 0)
    site = F.coalesce("site", F.array().cast("array<bigint>"))
    each = F.arrays_zip("hashes", "roles", "same")
    gone = F.when(marked, F.transform(each, lambda x: (x["roles"] > 0) & x["same"] & F.array_contains(site, x["hashes"]))).otherwise(F.col("same"))
    # only pages that lose a line are looked up; their texts stay where they are unless those are too many
    lost = stage(found.select("host", "key", gone.alias("gone")).where(F.exists("gone", lambda g: g)), "lost-lines")
    joined = rows.join(F.broadcast(lost) if fits_broadcast(lost) else lost, ["host", "key"], "left")
    least = F.when(F.exists("lines", lambda x: x["role"] > 0), 1).otherwise(0)
    text = _joined(F.filter("lines", lambda x, i: (x["role"] >= F.col("least")) & ~F.coalesce(F.get("gone", i), F.lit(False))))
    return joined.withColumn("least", least).select("page_id", "url", text.alias("text"))


@query("op5_html")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
