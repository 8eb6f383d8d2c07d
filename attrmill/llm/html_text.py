"""HTML main text by wrapper induction.

Every page is parsed to a tree. Its *frame* is the tree of block elements with
neighbours of one kind folded into one node (a run of paragraphs is one node). For
each host the largest frame is the reference; the frames of all its pages are
aligned with it by simple tree matching (the largest number of node pairs that keeps
order and ancestry). A node whose text is the same on all pages that have it, at
least `LEAST_PAGES` different ones, is template; varying nodes are slots. A page is known by
its largest varying text, so copies of one article count as one page whatever their trackers
or adverts; and a page whose varying text is less than `LEAST_VARYING` of its text tells nothing
about the template, so an article that all pages of a host share is not taken for it. Main text
is the slots' text: elements that HTML itself marks as no main text (menus,
forms, scripts, side notes, and whole class names or ids that say so) are left out; the
article or main element with most text, what is around it, and the body are never left
out by class name. Where articles hold `LEAST_SHARE` of the text of main (or of the page
without one), only they count; else, where main holds that share of the page, only main.
With less than that share, what is around them counts as well. No walk is recursive, so tags
may nest to any depth.

Wrappers are joined to their pages; they are broadcast only if all of them together are
at most `WRAPPER_BYTES`.

Blocks are separated by block elements; white space within one (also a line break)
becomes one space; character references are decoded.

Rows: null html is empty and gives an empty text. Pages without a host, and hosts
with too few different pages, have no template; then the element rules alone
decide. Repeated pages are treated alike. Other columns are not read.
"""

from __future__ import annotations

import functools
import html
import itertools
import json
import re
from collections import Counter
from operator import attrgetter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrmill.llm.common import Memo, Workspace, arrow_stage

LEAST_PAGES = 3
WRAPPER_BYTES = 8_000_000
LEAST_SHARE = 2 / 3
LEAST_VARYING = 1 / 5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption"
    " header footer nav aside form fieldset address details summary hr menu dialog center hgroup search".split()
)
SKIP = frozenset(
    "head script style title noscript template svg math object canvas audio video iframe nav footer aside form button select textarea input label dialog menu search".split()
)
#: Start tags that end an open paragraph, and those that end an open element of the given kinds.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("html body article section main div ul ol dl table blockquote td th header footer nav aside form figure".split())
_NOISE_WORD = (
    r"(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|sidebar|side"
    r"|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|share|sharing|social|related|recommend\w*|comments?|disqus|replies|respond|footer|header|masthead|widget|toolbar|skip)"
)
#: Words that leave the sense of a noise word as it is ('site-footer', 'sidebar-left', 'ad-3'); any other word changes it ('no-sidebar').
_NEUTRAL = r"(?:site|main|page|global|top|bottom|left|right|primary|secondary|mobile|desktop|box|bar|list|links?|items?|area|block|section|wrap|wrapper|container|inner|outer|\d+)"
_NOISE = re.compile(rf"(?:{_NEUTRAL}[_-]+)*{_NOISE_WORD}\d*(?:[_-]+(?:{_NEUTRAL}|{_NOISE_WORD}))*")
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z|[^<]+|<", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f\v  -     　]+")


@functools.lru_cache(10_000)
def noise_name(names: str) -> bool:
    return any(map(_NOISE.fullmatch, names.split()))


class Node:
    __slots__ = ("tag", "sign", "noise", "by_name", "kids")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.kids = tag, []
        found: dict[str, str] = {}
        for m in _ATTR.finditer(attrs) if attrs else ():
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # of two alike the first counts
        names = f"{found.get('class', '')} {found.get('id', '')}".lower().strip()
        self.sign = tag + ("." + re.sub(r"\d+", "", names) if names else "")
        self.noise = (
            tag in SKIP or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
            or found.get("role", "").lower() in _NOISE_ROLES
        )
        #: noise by nothing but its names
        self.by_name = not self.noise and bool(names) and tag not in ("html", "body", "main") and noise_name(names)
        self.noise = self.noise or self.by_name


def parse(text: str) -> Node:
    """The tree of a page; unclosed and stray tags are mended the way browsers do it."""
    root = Node("#root")
    stack, opened = [root], Counter()

    def close(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    at, n = 0, len(text)
    while at < n:
        m = _TOKEN.match(text, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            s = m.group()
            if s[0] != "<" or s == "<":
                stack[-1].kids.append(s)
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        ends = _ENDS.get(tag, ())
        if tag in BLOCK:
            ends = (*ends, "p")
        if any(opened[e] > 0 for e in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    close(k)
                    break
                if stack[k].tag in _SCOPE and not (tag == "tr" and stack[k].tag in ("td", "th")):
                    break
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
            node.kids.append(text[at : end.start() if end else n])
            if not end:
                break
            shut = text.find(">", end.start())
            at = n if shut < 0 else shut + 1
            continue
        stack.append(node)
        opened[tag] += 1
    return root


# ---- frames and their alignment ---------------------------------------------------------


def _inline(node: Node):
    """The strings and blocks of a node in page order, through its inline elements."""
    stack = [iter(node.kids)]
    while stack:
        k = next(stack[-1], None)
        if k is None:
            stack.pop()
        elif isinstance(k, str) or k.tag in BLOCK:
            yield k
        elif k.tag not in RAW:
            stack.append(iter(k.kids))


def frame_of(root: Node) -> tuple[list[list], list[list[Node]]]:
    """The folded tree of blocks as rows [parent's place, sign, hash of the own text, its
    length], parents first, and for each row the elements that it stands for. Blocks that
    are no main text have no text here."""
    rows, nodes = [], []
    todo = [(-1, root.sign, [root], False)]
    for at, (parent, sign, run, noise) in enumerate(todo):  # grows while it is walked
        noise = noise or run[0].noise
        parts = [list(_inline(n)) for n in run]
        own = "" if noise else _SPACE.sub(" ", "\n".join("".join(k for k in p if isinstance(k, str)) for p in parts)).strip()
        rows.append([parent, sign, xxhash.xxh3_64_intdigest(own.encode()) >> 1 if own else 0, len(own)])
        nodes.append(run)
        blocks = (k for p in parts for k in p if not isinstance(k, str))
        for (kind, skipped), group in itertools.groupby(blocks, attrgetter("sign", "noise")):
            todo.append((at, kind, list(group), noise or skipped))
    return rows, nodes


def _kids(rows: list[list]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in rows]
    for at, row in enumerate(rows[1:], 1):
        out[row[0]].append(at)
    return out


def aligned(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """(place in a, place in b) of the nodes below the roots that simple tree matching pairs:
    the largest number of pairs of one sign that keeps order and ancestry."""
    below_a, below_b = _kids(a), _kids(b)
    pairs = [(0, 0)]
    for x, y in pairs:  # grows while it is walked: all pairs whose ancestors are of one sign
        pairs += [(i, j) for i in below_a[x] for j in below_b[y] if a[i][1] == b[j][1]]
    weight: dict[tuple[int, int], int] = {}

    def best_sums(x: int, y: int) -> list[list[int]]:
        sums = [[0] * (len(below_b[y]) + 1)]
        for i in below_a[x]:
            above, row = sums[-1], [0]
            for j, other in enumerate(below_b[y]):
                row.append(max(above[j + 1], row[j], above[j] + weight.get((i, other), 0)))
            sums.append(row)
        return sums

    for x, y in reversed(pairs):
        weight[x, y] = 1 + best_sums(x, y)[-1][-1]
    out, todo = [], [(0, 0)]
    while todo:
        x, y = todo.pop()
        sums = best_sums(x, y)
        i, j = len(below_a[x]), len(below_b[y])
        while i and j:
            pair = below_a[x][i - 1], below_b[y][j - 1]
            w = weight.get(pair, 0)
            if w and sums[i][j] == sums[i - 1][j - 1] + w:
                out.append(pair)
                todo.append(pair)
                i, j = i - 1, j - 1
            elif sums[i][j] == sums[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return sorted(out)


# ---- extraction -------------------------------------------------------------------------


def _main(root: Node, tag: str) -> list[Node]:
    """The outermost elements of this tag outside noise, in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag == tag:
            out.append(n)
        else:
            todo.extend(k for k in reversed(n.kids) if isinstance(k, Node) and not k.noise)
    return out


def keep_longest(root: Node) -> None:
    """The article or main with most text, and what is around it, are no noise by name."""
    nodes, above = [root], [-1]
    for at, node in enumerate(nodes):  # grows while it is walked
        inner = [k for k in node.kids if isinstance(k, Node) and (not k.noise or k.by_name)]
        nodes += inner
        above += [at] * len(inner)
    chars = [sum(len(k.strip()) for k in node.kids if isinstance(k, str)) for node in nodes]
    for at in range(len(nodes) - 1, 0, -1):
        chars[above[at]] += chars[at]
    at = max((at for at, node in enumerate(nodes) if node.tag in ("article", "main")), key=lambda at: (chars[at], at), default=-1)
    while at >= 0:
        if nodes[at].by_name:
            nodes[at].noise = nodes[at].by_name = False
        at = above[at]


def blocks_of(node: Node, template: set[int], inside: bool) -> list[str]:
    """Main-text blocks below a node; ``inside`` is true within an article or main element."""
    out: list[str] = []
    line: list[str] = []

    def flush():
        s = _SPACE.sub(" ", html.unescape("".join(line))).strip()
        line.clear()
        if s:
            out.append(s)

    stack = [(iter(node.kids), id(node) not in template, True)]
    while stack:
        kids, own, block = stack[-1]
        k = next(kids, None)
        if k is None:
            stack.pop()
            if block:
                flush()
        elif isinstance(k, str):
            if own:
                line.append(k)
        elif k.noise or k.tag in RAW or (k.tag == "header" and not inside):
            if k.tag in BLOCK:
                flush()
        elif k.tag == "br":
            line.append("\n")
        elif k.tag in BLOCK:
            flush()
            stack.append((iter(k.kids), id(k) not in template, True))
        else:
            stack.append((iter(k.kids), own, False))
    return out


def page_tree(text: str) -> Node:
    root = parse(text)
    keep_longest(root)
    return root


def main_text(text: str, reference: list | None = None, constant: frozenset[int] = frozenset()) -> str:
    root = page_tree(text)
    template: set[int] = set()
    if reference and constant:
        rows, nodes = frame_of(root)
        template = {id(n) for a, b in aligned(reference, rows) if a in constant for n in nodes[b]}
    main, articles = _main(root, "main"), _main(root, "article")
    page = blocks_of(root, template, False)
    if not main and not articles:
        return "\n\n".join(page)
    around = [page]
    if main:
        around.append([b for n in main for b in blocks_of(n, template, True)])
    if articles:
        around.append([b for n in articles for b in blocks_of(n, template, True)])
    chosen = around[0]
    for inner in around[1:]:
        if sum(map(len, inner)) >= LEAST_SHARE * sum(map(len, chosen)):
            chosen = inner
    return "\n\n".join(chosen)


# ---- Spark ------------------------------------------------------------------------------


def _frames(batches):
    for b in batches:
        rows = []
        for host, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            f = frame_of(page_tree(text or ""))[0]
            rows.append((host, len(f), json.dumps(f, separators=(",", ":"))))
        cols = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()))], ["host", "size", "frame"])


def _align(batches):
    """The texts of a page: place in the reference (-1: not aligned), hash, length."""
    reference = Memo(json.loads, 2_000)
    for b in batches:
        rows = []
        for host, ref, frame in zip(*(b.column(i).to_pylist() for i in range(3))):
            f = json.loads(frame)
            place = {y: x for x, y in aligned(reference[ref], f)}
            texts = [(place.get(y, -1), row[2], row[3]) for y, row in enumerate(f) if row[2]]
            if texts:
                rows.append((host, *map(list, zip(*texts))))
        cols = list(zip(*rows)) if rows else [()] * 4
        kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["host", "places", "hs", "lens"])


def _extract(batches):
    wrapper = Memo(lambda w: (json.loads(w[0]), frozenset(w[1])), 2_000)
    for b in batches:
        text = []
        for h, ref, paths in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
            text.append(main_text(h or "", *(wrapper[ref, tuple(paths)] if ref and paths else ())))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))


def template_places(texts: DataFrame) -> DataFrame:
    """host, constant: places of the reference whose text is the same on all pages that have
    it, where these are at least `LEAST_PAGES` pages with different largest varying texts."""
    node = F.explode(F.arrays_zip("places", "hs")).alias("t")
    same = (
        texts.select("host", node).select("host", F.col("t.places").alias("place"), F.col("t.hs").alias("h")).filter("place >= 0")
        .groupBy("host", "place").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo = hi")
        .groupBy("host").agg(F.collect_list("place").alias("same"))
    )  # at most the reference's nodes for a host
    parts = F.arrays_zip("places", "hs", "lens")
    varying = F.filter(parts, lambda t: ~F.array_contains("same", t["places"]))
    chars = lambda ts: F.aggregate(ts, F.lit(0).cast("long"), lambda n, t: n + t["lens"])
    largest = F.array_max(F.transform(varying, lambda t: F.struct(t["lens"], t["hs"])))["hs"]
    return (
        texts.join(same, "host")
        .filter(chars(varying) >= F.lit(LEAST_VARYING) * chars(parts))
        .select("host", largest.alias("page"), F.explode(F.array_intersect("places", "same")).alias("place"))
        .distinct()
        .groupBy("host", "place").agg(F.count("page").alias("n")).filter(f"n >= {LEAST_PAGES}")
        .groupBy("host").agg(F.sort_array(F.collect_list("place")).alias("constant"))
    )


def learn_wrappers(pages: DataFrame, work: Workspace) -> DataFrame:
    """host, reference (its frame), constant (places of the template nodes)."""
    hosted = pages.select(host_of("url").alias("host"), "html").filter("host != ''")
    frames = work.save(arrow_stage(hosted, _frames, "host string, size long, frame string"), "frames")
    reference = work.save(frames.groupBy("host").agg(F.max(F.struct("size", "frame"))["frame"].alias("reference")), "references")
    schema = "host string, places array<int>, hs array<long>, lens array<long>"
    texts = work.save(arrow_stage(frames.join(reference, "host").select("host", "reference", "frame"), _align, schema), "texts")
    return work.save(reference.join(template_places(texts), "host"), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    work = Workspace(pages.sparkSession)
    wrappers = learn_wrappers(pages, work)
    total = wrappers.agg(F.sum(F.length("reference") + 4 * F.size("constant"))).first()[0] or 0
    rows = pages.select("page_id", "url", "html", F.nullif(host_of("url"), F.lit("")).alias("host"))
    rows = rows.join(F.broadcast(wrappers) if total <= WRAPPER_BYTES else wrappers, "host", "left").select("page_id", "url", "html", "reference", "constant")
    kind = pages.schema["page_id"].dataType.simpleString()
    return arrow_stage(rows, _extract, f"page_id {kind}, url string, text string, n_chars long")
