"""Main text of web pages: semantic branches first, then a site style tree per host.

1. Each page is parsed once, leniently, in time and memory that grow with its length, into blocks: the text between
   block-level tags, with the style path of the block (tags and classes from the root) and the sequence of the
   children of its parent. Branches that say what they are (nav, footer, aside, form, script, role, class and id words such as
   advert or comments, articles within articles) are left out there. Class and id words don't remove a branch
   that holds the only article or main, nor one that holds more than half of the page's text (unless an article or
   main stands elsewhere and the branch is named for comments, or has no other words in its names), nor one within
   article or main whose names have words of another subject.
2. All blocks are judged by the tree of their site, the merged DOMs of a host, where pages with the same blocks
   count once: the content importance of a style node is one less the mean entropy of its texts over the pages
   that have them (a text on every page tells nothing), the presentation importance the entropy of the child
   sequences of its parent; inside article and main it counts as full. Nodes whose weighted importance is low on
   at least ``min_pages`` pages are branches to remove. In nodes that stay each text is judged as a leaf, with
   full presentation importance: low ones that stand on more than half of the node's pages go. A page keeps its
   blocks if all would go, and so do its article and main.
3. If articles hold half of a page's text that is left, the page gives what is inside; else the same for
   articles and main; else all of it.

Scale: one parse; the blocks wait in a scratch table. Statistics are counts by (host, page, node, text) and then
by (host, node, text) with map-side combination, so a host with a third of all pages is a few rows per task;
pages meet the nodes and texts to remove by host in a join that adaptive execution broadcasts or splits. Nodes,
texts and pages are told apart by 64-bit hashes.

Defined cases: null html counts as empty and gives an empty text; a null or odd url is a host of its own kind
(the empty name), whose pages are judged together; unclosed tags, comments, scripts and cut-off tags at the
end are tolerated; repeated rows give one result row each; an empty table gives an empty result; other columns
are ignored. White space is Unicode white space after decoding.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, materialize, only, table

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|</?(?P<bad>[a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp".split())
BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre section article main header footer nav aside address figure figcaption hr form fieldset details summary body html head".split())
NOISE = frozenset("head nav footer aside form button select option dialog menu input label object canvas audio video".split()) | RAW
#: Words of class and id names, and roles, of branches that are no article text.
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations comment comments commentlist disqus reply replies respond login search searchbox pagination pager widget skip hidden".split())
#: Those for what readers write, which may well be more than the article.
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words that say where a branch is or what holds it, not what it is about: beside those above they change nothing.
NEUTRAL = frozenset("site page main block box container wrapper wrap inner outer section area slot list item items left right top bottom global primary secondary column col row grid panel module region zone unit group bar holder body link links icon icons button buttons btn recent post posts article story content mobile desktop small large fixed sticky inline js".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"body", "html", "head"}
STOP_AT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "p": {"div", "section", "article", "main", "td", "th", "li", "blockquote", "body", "aside", "footer", "header", "nav", "form", "dd", "figure", "details"}}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)} if text.strip() else {}


def _names(attrs: dict[str, str]) -> set[str]:
    """Words of class and id; `no-sidebar` and the like say something about the page, not about the branch."""
    text = re.sub(r"\b(?:has|with|without|no|hide)[-_]\w+", " ", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())
    return set(re.split(r"[^a-z0-9]+", text))


def _noisy(name: str, attrs: dict[str, str], in_article: bool, text: str) -> bool:
    """Whether tag, role or style say that a branch is no article text."""
    if name in NOISE or name == "article" and in_article or name == "header" and not in_article:
        return True
    if not attrs and "hidden" not in text:
        return False
    if attrs.get("role", "").lower() in NOISE_ROLES or attrs.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|$|=)", text) or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return name not in ("body", "html", "main")
    return False


def _noise_names(name: str, attrs: dict[str, str], in_text: bool) -> tuple[bool, bool]:
    """Whether words of class and id say so, and whether they say it plainly: for comments, or without other words.
    Within article and main a word of another subject (share-price, notice-of-motion) speaks for the branch."""
    if not attrs or name in ("body", "html", "main"):
        return False, False
    words = _names(attrs) - {""}
    noise = words & NOISE_WORDS | ({"header"} if "header" in words and name != "article" and not in_text else set())
    readers = bool(words & READERS)
    if in_text and not readers and words - noise - NEUTRAL:
        return False, False
    return bool(noise), bool(noise) and (noise == words or readers)


class _Node:
    __slots__ = ("name", "path", "noise", "branch", "article", "main", "children", "block", "parent", "look")

    def __init__(self, name: str, path: int, noise: bool, branch: int, article: int | None, main: int | None, block: bool, parent: _Node | None):
        """``branch``: the number of the innermost branch around that class and id words speak against (-1: none); ``article``, ``main``: that of the article and main that it is in."""
        self.name, self.path, self.noise, self.branch, self.article, self.main, self.block, self.parent = name, path, noise, branch, article, main, block, parent
        self.children: list[str] = []
        self.look: int | None = None


def _dropped(out: list[tuple[list[tuple[str, _Node]], _Node]], around: list[int], plainly: list[bool]) -> list[bool]:
    """Of the branches with such class and id words, in the order of their begin and with the branch around each, those to leave out."""
    n = len(around)
    chars, total, articles, mains = [0] * n, 0, set(), set()
    for pieces, _ in out:
        for piece, node in pieces:
            if k := len("".join(piece.split())) if n else 0:
                total += k
                if node.branch >= 0:
                    chars[node.branch] += k
                if node.article is not None:
                    articles.add(node.article)
                if node.main is not None:
                    mains.add(node.main)

    def within(found: set[int]) -> list[int]:
        counts = [0] * n
        for k in found - {-1}:
            counts[k] += 1
        return summed(counts)

    def summed(counts: list[int]) -> list[int]:
        for k in range(n - 1, -1, -1):  # branches come after those around them
            if around[k] >= 0:
                counts[around[k]] += counts[k]
        return counts

    chars, both, of_articles, of_mains = summed(chars), within(articles | mains), within(articles), within(mains)
    gone: list[bool] = []
    for k in range(n):
        held = -1 not in articles and of_articles[k] or -1 not in mains and of_mains[k]
        elsewhere = len(articles | mains) > both[k]
        gone.append(around[k] >= 0 and gone[around[k]] or not held and (2 * chars[k] <= total or plainly[k] and elsewhere))
    return gone


def blocks_of(page: str) -> list[tuple[str, int, int, int]]:
    """Blocks of a page in order: text; 2 in an article, 1 in main, 0 elsewhere; hash of the style path; hash of the child sequence that the block is in. A page that class and id names would empty is read without them."""
    stack = [_Node("", 0, False, -1, None, None, True, None)]
    out: list[tuple[list[tuple[str, _Node]], _Node]] = []
    around: list[int] = []
    plainly: list[bool] = []
    words: list[tuple[str, _Node]] = []
    is_open: Counter[str] = Counter()
    unended: set[str] = set()
    styles: dict[tuple[int, str], int] = {}

    def flush() -> None:
        if words:
            node = stack[-1]
            while not node.block:
                node = node.parent
            out.append((words.copy(), node))
            words.clear()

    def close(to: int) -> None:
        if any(n.block for n in stack[to:]):
            flush()
        is_open.subtract(n.name for n in stack[to:])
        del stack[to:]

    def read(dropped: list[bool]) -> list[tuple[str, int, int, int]]:
        blocks = []
        for pieces, node in out:
            text = "".join(piece for piece, of in pieces if not (dropped and of.branch >= 0 and dropped[of.branch]))
            if text := " ".join(_html.unescape(text).split()):
                parent = node.parent or node
                if parent.look is None:
                    parent.look = zlib.crc32(",".join(parent.children).encode("utf-8", "surrogatepass"))
                blocks.append((text, 0 if node.article is None and node.main is None else 1 if node.article is None else 2, node.path, parent.look))
        return blocks

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None or m.start() > at:
            if not stack[-1].noise:
                words.append((page[at:] if m is None else page[at : m.start()], stack[-1]))
        if m is None:
            break
        at = m.end()
        name = (m["name"] or m["bad"] or "").lower()
        if not name:
            continue
        if m["end"] or page.startswith("</", m.start()):
            if is_open[name] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        close(k)
                        break
            continue
        top = stack[-1]
        if name == "br" or name in VOID:
            if name == "hr" and not top.noise:
                flush()
            elif not top.noise:
                words.append((" ", top))
            continue
        if name in RAW:
            if name == "svg" and (m["attrs"] or "").rstrip().endswith("/"):
                continue
            stop = None if name in unended else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if stop is None:
                unended.add(name)
            at = stop.end() if stop else at if name == "svg" else len(page)
            continue
        if name in ENDS_P or name in CLOSES:
            for wanted, among in ((CLOSES.get(name), STOP_AT.get(name, set())), ({"p"} if name in ENDS_P else None, STOP_AT["p"])):
                if wanted and any(is_open[w] > 0 for w in wanted):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].name in wanted:
                            close(k)
                            break
                        if stack[k].name in among:
                            break
            top = stack[-1]
        if m["attrs"] is None:
            attrs, text = {}, ""
        else:
            text = m["attrs"]
            attrs = _attributes(text)
        style = name + ("." + ".".join(sorted(attrs["class"].split())) if attrs.get("class") else "")
        noise = top.noise or _noisy(name, attrs, top.article is not None, text)
        block = name in BLOCK
        if block and not top.noise:
            flush()
        if block:
            top.children.append(style)
        if not text.rstrip().endswith("/") or block:
            branch = top.branch
            found, plain = (False, False) if noise else _noise_names(name, attrs, top.article is not None or top.main is not None)
            if found:
                branch = len(around)
                around.append(top.branch)
                plainly.append(plain)
            article = branch if name == "article" and not noise else None if noise else top.article
            main = branch if name == "main" or attrs.get("role") == "main" else top.main
            path = top.path
            if block and not noise:
                if (path := styles.get((top.path, style))) is None:
                    path = styles[top.path, style] = _hash(str(top.path), style)
            stack.append(_Node(name, path, noise, branch, article, main, block, top))
            is_open[name] += 1
    if not stack[-1].noise:
        flush()
    return read(_dropped(out, around, plainly)) or read([])


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


_BLOCKS = "page_id {id}, url {url}, host string, page long, blocks array<struct<text:string,kind:int,node:long,look:int,content:long>>"


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _judged(blocks: list[tuple[str, int, int, int]], nodes: dict[tuple[bool, int], int]) -> list[dict]:
    """Blocks with hashes of their style nodes and texts; the first one of a node has what the node's parent looks like."""
    out, looks = [], {}
    for text, kind, path, seen in blocks:
        key = (kind > 0, path)
        if (node := nodes.get(key)) is None:
            node = nodes[key] = _hash(str(int(kind > 0)), str(path))
        out.append({"text": text, "kind": kind, "node": node, "look": None, "content": _hash(str(node), text)})
        first, least = looks.get(node, (out[-1], seen))
        looks[node] = (first, min(least, seen))
    for first, look in looks.values():
        first["look"] = look - (1 << 31)
    return out


def parse_pages(pages: DataFrame) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = _BLOCKS.format(id=pages.schema["page_id"].dataType.simpleString(), url=pages.schema["url"].dataType.simpleString())
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                blocks, hosts, nodes = [], [], {}
                for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist()):
                    hosts.append(host_of(url))
                    blocks.append(_judged(blocks_of(page or ""), nodes))
                same = [_hash(*(str(b["content"]) for b in bs)) for bs in blocks]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(hosts, pa.string()), pa.array(same, pa.int64()), pa.array(blocks, schema.field("blocks").type)], schema=schema)

    return only(pages, "page_id", "url", "html").mapInArrow(run, ddl)


def low_nodes(parsed: DataFrame, min_pages: int, threshold: float, content_weight: float) -> DataFrame:
    """(host, low): the style nodes, and the texts of other nodes, of each host's tree that are to be removed."""
    b = parsed.select("page", "host", F.explode("blocks").alias("b")).select("page", "host", "b.node", "b.kind", "b.look", "b.content")
    b = b.groupBy("host", "page", "node", "content").agg(F.min("look").alias("look"), F.max("kind").alias("kind"))  # once a distinct page
    per_text = b.groupBy("host", "node", "content").agg(F.count("*").alias("k"))
    looks = b.where("look is not null").groupBy("host", "node", "look").agg(F.count("*").alias("n"), F.max("kind").alias("kind"))
    looks = looks.groupBy("host", "node").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.max("kind").alias("kind"))
    looks = looks.where(F.col("m") >= max(2, min_pages))
    # entropy to base m, the number of pages that have the node: of child sequences, and of each text over its k pages (log k)
    presentation = F.when(F.col("kind") > 0, 1.0).otherwise((F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m"))
    importance = lambda logk, shown: content_weight * (1 - logk / F.log("m")) + (1 - content_weight) * shown
    content = per_text.groupBy("host", "node").agg(F.avg(F.log("k")).alias("logk"))
    nodes = looks.join(content, ["host", "node"]).where(importance(F.col("logk"), presentation) < threshold)
    texts = looks.select("host", "node", "m").join(per_text.where(F.col("k") >= min_pages), ["host", "node"])
    texts = texts.where((importance(F.log("k"), F.lit(1.0)) < threshold) & (2 * F.col("k") > F.col("m")))
    low = nodes.select("host", F.col("node").alias("low")).unionByName(texts.select("host", F.col("content").alias("low")))
    return low.groupBy("host").agg(F.collect_set("low").alias("low"))


def _main_text(blocks: Column, low: Column) -> Column:
    """The text of a page, from its blocks and what is low on its host. Each step is computed once for the page."""

    def judged(m: Column) -> Column:
        inside = F.exists(m, lambda b: b["kind"] > 0) & ~F.exists(m, lambda b: (b["kind"] > 0) & b["fine"])
        return bound(F.struct(m.alias("m"), inside.alias("inside")), left)

    def left(s: Column) -> Column:
        # a page whose article and main would be emptied keeps them, and one that would be emptied keeps all
        kept = F.filter(s["m"], lambda b: b["fine"] | (s["inside"] & (b["kind"] > 0)))
        return bound(bound(kept, lambda k: F.when(F.size(k) == 0, s["m"]).otherwise(k)), levelled)

    def levelled(k: Column) -> Column:
        chars = F.aggregate(
            k,
            F.struct(*[F.lit(0).cast("long").alias(f"n{i}") for i in range(3)]),
            lambda n, b: F.struct(*[(n[f"n{i}"] + F.when(b["kind"] >= i, b["n"]).otherwise(0)).cast("long").alias(f"n{i}") for i in range(3)]),
            lambda n: F.when(2 * n["n2"] >= n["n0"], 2).when(2 * n["n1"] >= n["n0"], 1).otherwise(0),
        )
        return bound(F.struct(k.alias("k"), chars.alias("level")), lambda t: F.array_join(F.transform(F.filter(t["k"], lambda b: b["kind"] >= t["level"]), lambda b: b["text"]), "\n"))

    fine = lambda b: F.when(low.isNull(), True).otherwise(~(F.array_contains(low, b["node"]) | F.array_contains(low, b["content"])))
    return bound(F.transform(blocks, lambda b: F.struct(b["text"].alias("text"), b["kind"].alias("kind"), F.length(b["text"]).alias("n"), fine(b).alias("fine"))), judged)


def extract_text(pages: DataFrame, min_pages: int = 4, threshold: float = 0.4, content_weight: float = 0.7) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    parsed = materialize(parse_pages(pages), "html-blocks")
    low = materialize(low_nodes(parsed, min_pages, threshold, content_weight), "html-low-nodes")
    judged = parsed.join(low, "host", "left")
    return judged.select("page_id", "url", _main_text(F.col("blocks"), F.col("low")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
