"""Main text of pages by a site style tree.

The pages of a host are merged into one tree of element styles: a node is the path of tags, classes and
ids from the body, with digits levelled. For every node that holds text, all pages of the host give two
entropies, relative to the number of different pages: that of its content (do pages say different things
there?) and that of its presentation (do pages lay it out differently there?). The larger one, times a
prior, is the node's importance. Branches of low importance, against the most important node of the host,
are cut from each page; what is left is its text. Pages that are equal count once in the tree.

The prior is one, or ``TreeRules.prior`` where a node's elements or style words name page furniture (menus,
adverts, forms and so on), or where it lies outside the article or main element of its page. It settles
what entropies cannot: furniture that differs on every page, and hosts of few pages, where every node has
the importance of its prior. A plain element of the article (without class or id) is as important as can be,
so repeated articles of a host stay.

Statistics are counted by (host, node, content) with partial aggregation, so a hot host is dealt out over
tasks. The nodes to cut reach the pages by a broadcast if all of them together are small, else by a join on
(host, node) of each different page's own nodes.

Edge cases: a null or empty html has an empty text. A null or odd url is of the host ''. Unclosed and
stray tags are read as browsers do, roughly. A page without article or main element gives all blocks that
are not cut. Very long and deeply nested pages are parsed whole, in linear time. Repeated rows give equal
rows. An empty table gives an empty result. Only the id, url and html columns are read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, slices, staged


@dataclass(frozen=True)
class TreeRules:
    #: A node needs so many different pages before its entropies count; with fewer they count as one.
    min_pages: int = 4
    #: A node is cut below this part of the largest importance among the host's nodes.
    least_importance: float = 0.2
    #: What names and place say against a node.
    prior: float = 0.1


#: Elements whose content is no markup, up to their end tag.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose start closes an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
LANDMARKS = frozenset(("article", "main"))
NOISE_TAGS = frozenset("nav aside footer form menu dialog head button fieldset search template noscript object svg canvas math audio video select datalist".split())
#: Words of classes, ids and roles that name page furniture.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments commentlist consent contentinfo cookie cookies copyright disqus footer "
    "advertorial feedback gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion recommended related "
    "replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: Words that may stand beside those in a compound: "ad-box" names furniture, "social-science" does not.
PLACE_WORDS = frozenset("area bar block bottom box button buttons column container content form global group header holder icons inner item items left link links list main message outer page panel policy post posts primary reader readers right row secondary section site slot text title top unit wrap wrapper".split())
NOISE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())

#: An open paragraph is looked for up to one of these; an open item, row or cell up to one of those.
P_SCOPE = frozenset("td th button caption table".split())
ITEM_SCOPE = frozenset("ul ol dl table tbody menu".split())
ITEMS = {"li": 0, "dt": 1, "dd": 1, "tr": 2, "td": 3, "th": 3, "option": 4}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*?)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.IGNORECASE)
_MAIN_ROLE = re.compile(r"""role\s*=\s*["']?main\b""")
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _style(tag: str, attributes: str) -> tuple[str, bool]:
    """A node's style, and whether it names page furniture."""
    noise = tag in NOISE_TAGS
    if not attributes.strip():
        return tag, noise
    style = tag
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            noise = True
        elif name == "style":
            noise |= "display:none" in value.replace(" ", "").lower()
        elif name == "role":
            noise |= value.strip().lower() in NOISE_ROLES
        elif name in ("class", "id"):
            level = _DIGITS.sub("0", value.strip())
            style += ("." if name == "class" else "#") + ".".join(sorted(level.split()))
            for word in value.split():
                parts = [x.lower() for x in _PARTS.split(word) if x and not x.isdigit()]
                noise |= any(x in NOISE_WORDS for x in parts) and all(x in NOISE_WORDS or x in PLACE_WORDS for x in parts)
    return style, noise


@dataclass
class Block:
    #: The style path's hash.
    node: int
    text: str
    #: Lies in an article or main element; that element is plain; the style names page furniture.
    landmark: bool
    plain: bool
    noise: bool


@dataclass(frozen=True)
class _Frame:
    tag: str
    node: int
    landmark: bool = False
    plain: bool = True
    noise: bool = False
    #: Where on the stack the paragraph in scope is, and the items by kind; -1 for none.
    paragraph: int = -1
    items: tuple[int, ...] = (-1,) * 5


_ROOT = _Frame("", 0)


def blocks(html: str | None) -> list[Block]:
    """The text blocks of a page in page order."""
    html = html or ""
    stack: list[_Frame] = [_ROOT]
    opened: Counter = Counter()
    found: list[Block] = []
    said: list[str] = []
    at, end = 0, len(html)

    def close() -> None:
        nonlocal inline, other
        if said:
            text = " ".join("".join(said).split())
            said.clear()
            if text:
                f = stack[-1]
                if inline and not other:
                    # The block is an inline element's: a node of its own below the block's.
                    found.append(Block(inline, text, f.landmark, False, True))
                else:
                    found.append(Block(f.node, text, f.landmark, f.plain, f.noise))
        inline, other = (inline if at < inside else 0), False

    def leave(place: int) -> None:
        """Closes the elements from that place of the stack on."""
        while len(stack) > place:
            opened[stack.pop().tag] -= 1

    # Furniture in inline elements: up to where the open one reaches, its node, and whether the block has other text.
    inside, inline, other = 0, 0, False
    ends: dict[str, dict[int, int]] = {}

    def inline_end(tag: str, start: int) -> int:
        """Where the inline element that starts there ends, or its start if it is never closed."""
        if tag not in ends:
            own: dict[int, int] = {}
            waiting: list[int] = []
            for m in re.finditer(rf"<(/?){tag}(?![^\s/>])", html, re.IGNORECASE):
                if not m[1]:
                    waiting.append(m.start())
                elif waiting:
                    own[waiting.pop()] = m.start()
            ends[tag] = own
        return ends[tag].get(start, start)

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            said.append(entities.unescape(html[at:lt]))
            other |= at >= inside and not said[-1].isspace()
        if lt == end:
            break
        token = _TOKEN.match(html, lt)
        if token is None:
            said.append("<")
            other |= at >= inside
            at = lt + 1
            continue
        at = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        if token[1] or token[4]:
            if tag in INLINE:
                continue
            if opened[tag]:
                close()
                place = len(stack) - 1
                while stack[place].tag != tag:
                    place -= 1
                leave(place)
            elif tag in ("br", "p"):
                close()
            continue
        attributes = token[3] or ""
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            at = stop.end() if stop else end
            continue
        if tag in INLINE:
            if lt >= inside and not other and attributes.strip():
                style, noise = _style(tag, attributes)
                if noise and (stop := inline_end(tag, lt)) > lt:
                    inside, inline = stop, inline or _hash(str(stack[-1].node), style)
            continue
        close()
        if tag in VOID or attributes.endswith("/") and tag not in CLOSES_P:
            continue
        if tag in CLOSES_P and stack[-1].paragraph > 0:
            leave(stack[-1].paragraph)
        kind = ITEMS.get(tag)
        if kind is not None and stack[-1].items[kind] > 0:
            leave(stack[-1].items[kind])
        opened[tag] += 1
        if tag in ("html", "body"):
            stack.append(_Frame(tag, 0))
            continue
        up = stack[-1]
        style, noise = _style(tag, attributes)
        noise |= lt < inside
        if tag == "header":
            noise |= not up.landmark
        opens = tag in LANDMARKS or _MAIN_ROLE.search(attributes) is not None
        items = (-1,) * 5 if tag in ITEM_SCOPE else up.items
        if kind is not None:
            items = (*items[:kind], len(stack), *items[kind + 1 :])
        stack.append(
            _Frame(
                tag,
                _hash(str(up.node), style),
                up.landmark or (opens and not noise),
                (up.plain or opens) and (style == tag or opens),
                up.noise or noise,
                len(stack) if tag == "p" else -1 if tag in P_SCOPE else up.paragraph,
                items,
            )
        )
    close()
    return found


def _hash(*parts: str) -> int:
    digest = hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def _doubted(own: list[Block]) -> list[bool]:
    """For each block, whether its names or its place speak against it."""
    has_landmark = any(b.landmark and not b.noise for b in own)
    return [b.noise or (has_landmark and not b.landmark) for b in own]


def site_tree(pages: DataFrame) -> DataFrame:
    """(host, node, doubted, plain, m, content, presentation): pages and relative entropies of every text node of the merged trees."""

    def run(batches: Iterator[pa.RecordBatch]):
        schema = pa.schema([("host", pa.string())] + [(n, pa.int64()) for n in ("node", "content", "layout", "page")] + [("doubted", pa.bool_()), ("plain", pa.bool_())])
        for batch in slices(batches):
            rows = []
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, page = host_of(url), _hash(html or "")
                own = blocks(html)
                texts: dict[tuple, list[str]] = {}
                for b, doubted in zip(own, _doubted(own), strict=True):
                    texts.setdefault((b.node, doubted, b.landmark and b.plain), []).append(b.text)
                rows += [{"host": host, "node": n, "content": _hash(*t), "layout": len(t), "page": page, "doubted": d, "plain": p} for (n, d, p), t in texts.items()]
            yield pa.RecordBatch.from_pylist(rows, schema)

    keys = ["host", "node", "doubted", "plain"]
    seen = pages.select("url", "html").mapInArrow(run, "host string, node long, content long, layout long, page long, doubted boolean, plain boolean").distinct()

    def entropy(column: str, name: str) -> DataFrame:
        counts = seen.groupBy(*keys, column).agg(F.count("*").cast("double").alias("c"))
        # Entropy is log m minus the mean of log c over pages; relative to log m.
        sums = counts.groupBy(*keys).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
        return sums.select(*keys, "m", F.when(F.col("m") > 1, 1 - F.col("clogc") / F.col("m") / F.log("m")).otherwise(1.0).alias(name))

    return entropy("content", "content").join(entropy("layout", "presentation").drop("m"), keys)


def low_nodes(tree: DataFrame, rules: TreeRules) -> DataFrame:
    """(host, node, doubted): the nodes of low importance."""
    entropies = F.when((F.col("m") < rules.min_pages) | F.col("plain"), 1.0).otherwise(F.greatest("content", "presentation"))
    scored = tree.withColumn("importance", entropies * F.when(F.col("doubted"), rules.prior).otherwise(1.0))
    best = scored.groupBy("host").agg(F.max("importance").alias("best"))
    return scored.join(best, "host").where(F.col("importance") < rules.least_importance * F.col("best")).select("host", "node", "doubted").distinct()


def _cut_of_pages(pages: DataFrame, low: DataFrame) -> DataFrame:
    """Pages (with their host) and what of them is cut: node numbers, doubled, plus one where doubted."""
    number = (F.col("node").cast("decimal(20,0)") * 2 + F.col("doubted").cast("int")).cast("string")
    if low.count() * 64 <= BROADCAST_BYTES:
        by_host = low.groupBy("host").agg(F.collect_set(number).alias("cut"))
        return pages.join(F.broadcast(by_host), "host", "left")

    def own_nodes(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            place, nodes, doubts = [], [], []
            for i, html in enumerate(batch.column(2).to_pylist()):
                own = blocks(html)
                place += [i] * len(own)
                nodes += [b.node for b in own]
                doubts += _doubted(own)
            place = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), pa.array(nodes, pa.int64()), pa.array(doubts, pa.bool_())], ["host", "digest", "node", "doubted"])

    # A page has few nodes, so what is gathered by page is small.
    digested = pages.withColumn("digest", F.sha1(F.coalesce("html", F.lit(""))))
    nodes = digested.select("host", "digest", "html").mapInArrow(own_nodes, "host string, digest string, node long, doubted boolean").distinct()
    cut = nodes.join(low, ["host", "node", "doubted"], "left_semi").groupBy("host", "digest").agg(F.collect_set(number).alias("cut"))
    return digested.join(cut, ["host", "digest"], "left")


def main_text(pages: DataFrame, rules: TreeRules = TreeRules()) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_cut of every page."""
    with Scratch(pages.sparkSession) as scratch:
        return scratch.kept(_main_text(pages, rules), "site-text")


def _main_text(pages: DataFrame, rules: TreeRules) -> DataFrame:
    pages = pages.select("page_id", "url", "html")
    tree = staged(site_tree(pages), "site-tree")
    low = staged(low_nodes(tree, rules), "site-low")
    with_host = pages.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    joined = _cut_of_pages(with_host, low).select("page_id", "url", "html", "cut")

    def run(batches: Iterator[pa.RecordBatch]):
        last, low_here = None, frozenset()
        for batch in slices(batches):
            texts, counts, cuts = [], [], []
            for html, cut in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                cut = tuple(cut.as_py() or ())
                if cut != last:
                    last, low_here = cut, frozenset(map(int, cut))
                own = blocks(html)
                kept = [b.text for b, doubted in zip(own, _doubted(own), strict=True) if 2 * b.node + doubted not in low_here]
                texts.append(" ".join(kept))
                counts.append(len(own))
                cuts.append(len(own) - len(kept))
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(counts, pa.int64()), pa.array(cuts, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars", "n_blocks", "n_cut"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_cut long")
