"""Main text of web pages by a site style tree.

The DOMs of one host are merged: elements with the same path of tags, classes and ids are one node of the host's tree. Over
the m pages that have a node,

    presentation importance = - sum_s p_s log_m p_s         p_s: share of pages that lay out its children as s
    content importance      = 1 - mean_i (log_m n_i)        n_i: pages that have its text i
    importance of a branch  = (1 - GAMMA) presentation + GAMMA (mean content importance below it)

so what looks and reads alike on every page of a site scores low. A block goes if its own node is below CUT, and stays if not; a
node in a marked article, main or content part counts as RAISE more important than it scores. The tree needs at least LEAST pages
of the node; there, a block also goes if ALL of them or more have its text. A heading (LEADS) that the prior leaves stays whatever the
tree says if the next block that is no heading stays, so the headings of a recipe stay and those of an advert go with it. Where it has fewer, a prior decides: a page that marks
such parts is those parts only. Before both, what markup itself declares has importance 0: navigation, page header and footer,
aside, form, button, script, style and elements whose class, id or role is menu, advert, notice, comments and the like (whole
names, or names made of such words and of FILLER words only: `related-posts` is noise, `related-work` is not).

Every page is parsed once; its blocks and nodes are written to a table, from which the counts of the tree, the decisions and the
result are taken. Sums over the texts of a node are reduced before they meet the node's page count, as
sum (1 - log_m n_i) = count - (sum ln n_i) / ln m, so a node that a third of all pages share is no hot group.

Blocks are split at block elements, white space in a block becomes one space, blocks are joined by two newlines.

Defined cases: null or empty html gives an empty text; null url is a host of its own; broken markup (unclosed or stray tags, cut
entities) is read on as browsers do, roughly; elements nested deeper than DEEP share the node at that depth, their text stays;
repeated rows, also of one page_id or of none, give repeated rows; pages of a host whose texts without declared noise are equal
count as one page; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import small_batches, written

GAMMA, CUT, LEAST, RAISE, ALL, DEEP = 0.8, 0.35, 4, 0.15, 0.9, 128

#: Elements without content, elements that break text into blocks, elements whose content is never text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: Elements that head what follows them.
LEADS = ("h1", "h2", "h3", "h4", "h5", "h6", "th", "dt", "summary", "caption", "figcaption")
RAW = frozenset("script style noscript template iframe noembed noframes title textarea".split())
#: Elements, and names of a class, id or role, that declare what is not the article.
NOISE = frozenset("nav footer aside form button select dialog menu head fieldset".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice alert popup "
    "modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside complementary footer masthead topbar toolbar comment comments "
    "reply replies respond disqus share sharing social related recommended newsletter subscribe signup login search pagination pager skip "
    "contentinfo widget".split()
)
#: Words that a name of noise may have beside those, and whole names that declare content.
FILLER = frozenset(
    "area bar block bottom box btn button buttons card cards column container entry form global group header icon icons inner item items left link "
    "links list main mobile outer page panel post posts primary right row secondary section site slot text title to top unit wrap wrapper".split()
)
CONTENT = frozenset("content maincontent main-content article article-body article-content post-content post-body entry-content story story-body".split())
#: Which open elements a start tag ends, and where the search for them stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: A quote opens a value only right after the sign =; elsewhere it is a character like others.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^=>]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|=)*+)(?:>|\Z)|[^<]+|<", re.S)
MARK = re.compile(r"""(?<![^\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _declares(name: str) -> bool:
    """Whether a class, id or role is a word of noise, or is made of such words and fillers only."""
    words = [w.lower() for w in WORDS.findall(name) if len(w) > 1]
    return any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in FILLER for w in words)


@functools.lru_cache(8192)
def _node(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """(tag with its class, id and role; declared noise; declared article or main; declared content)."""
    said = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in MARK.finditer(attributes)} if "=" in attributes else {}
    names = [n for v in said.values() for n in v.split()]
    name = tag + "".join(f"[{k}={' '.join(said[k].split())}]" for k in sorted(said))
    noise = tag in NOISE or tag == "header" or (tag not in ("html", "body", "article", "main") and any(map(_declares, names)))
    return name, noise, tag in ("article", "main") or "main" in said.get("role", "").split(), any(n.lower() in CONTENT for n in names)


class Block:
    """One block of text: the key of its own element, its text, what the markup declares of it, and whether it is a heading."""

    __slots__ = ("article", "lead", "node", "noise", "region", "text")

    def __init__(self, node: int, text: str, noise: bool, article: bool, region: int, lead: bool):
        self.node, self.text, self.noise, self.article, self.region, self.lead = node, text, noise, article, region, lead


def _below(node: int, name: str) -> int:
    return xxhash.xxh64_intdigest(f"{node:x}/{name}", 3) >> 1


ROOT = xxhash.xxh64_intdigest("", 3) >> 1


def parse(html: str) -> tuple[list[Block], dict[int, tuple[list[str], list[int]]]]:
    """The blocks of a page in order, noise included; and of every node its children in order, and the nodes above it with itself."""
    out: list[Block] = []
    nodes: dict[int, tuple[list[str], list[int]]] = {ROOT: ([], [ROOT])}
    stack: list[tuple[str, int, bool, bool, int]] = []  # tag, node, noise or within it, article or within it, content part or 0
    opened: Counter = Counter()
    text: list[str] = []
    mute: list = []  # an inline element of noise: its tag, how many of that tag are open, the depth of the stack
    regions = 0

    def lays_out(node: int, name: str) -> None:
        said = nodes[node][0]
        if not said or said[-1] != name:
            said.append(name)

    def flush() -> None:
        if text:
            said = " ".join("".join(text).split())
            text.clear()
            if said:
                _, node, noise, article, region = stack[-1] if stack else ("", ROOT, False, False, 0)
                lays_out(node, "#text")
                out.append(Block(node, said, noise, article, region, any(opened[t] for t in LEADS)))

    def close(tags: set, stop: set) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                for s in stack[k:]:
                    opened[s[0]] -= 1
                del stack[k:]
                if mute and len(stack) < mute[2]:
                    mute.clear()
                return
            if stack[k][0] in stop:
                return

    at, end, match = 0, len(html), TOKEN.match
    while at < end:
        m = match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if not mute and (html[m.start()] != "<" or m.end() - m.start() == 1):
                text.append(unescape(m[0]))
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                flush()
                close({tag}, set())
            elif mute and tag == mute[0]:
                mute[1] -= 1
                if not mute[1]:
                    mute.clear()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        if tag in ("br", "hr", "img", "wbr"):
            if tag == "hr":
                flush()
            elif tag != "wbr":
                text.append(" ")
            continue
        if tag in VOID:
            continue
        if tag not in BLOCK:
            if mute:
                mute[1] += tag == mute[0]
            elif not m[3].endswith("/") and (tag in NOISE or ("=" in m[3] and _node(tag, m[3])[1])):
                mute[:] = [tag, 1, len(stack)]
            continue
        flush()
        close({"p"}, {"table", "td", "th", "button", "caption"})
        if tag in ENDS:
            close(*ENDS[tag])
        name, noise, article, content = _node(tag, m[3])
        _, above, in_noise, in_article, region = stack[-1] if stack else ("", ROOT, False, False, 0)
        if tag == "header" and (in_article or region):
            noise = any(map(_declares, re.findall(r"[^\[\]= ]+", name[6:])))  # an article's own heading
        lays_out(above, name)
        node = above
        if len(stack) < DEEP:
            node = _below(above, name)
            if node not in nodes:
                nodes[node] = ([], [*nodes[above][1], node])
        if content and not region:
            regions += 1
            region = regions
        stack.append((tag, node, noise or in_noise or bool(mute), article or in_article, region))
        opened[tag] += 1
    flush()
    return out, nodes


def judged(blocks: list[Block]) -> list[tuple[Block, bool, bool]]:
    """The blocks that are not declared noise; whether the prior leaves them: those of the marked parts if there are any, else all;
    whether they are marked. A content part that holds an article or main part is marked only there."""
    kept = [b for b in blocks if not b.noise]
    wider = {b.region for b in kept if b.article}
    marked = [b.article or (b.region > 0 and b.region not in wider) for b in kept]
    some = any(marked)
    return [(b, m or not some, m) for b, m in zip(kept, marked)]


def with_leads(kept: list[bool], lefts: list[bool], leads: list[bool]) -> list[bool]:
    """kept, and headings that the prior leaves and that lead kept text: the next block that is no heading is kept."""
    out, follows = list(kept), False
    for i in range(len(out) - 1, -1, -1):
        if not leads[i]:
            follows = kept[i]
        elif lefts[i] and follows:
            out[i] = True
    return out


def candidates(html: str) -> list[Block]:
    """The blocks that the prior leaves."""
    return [b for b, left, _ in judged(parse(html)[0]) if left]


def _text(said: str) -> int:
    return xxhash.xxh64_intdigest(said, 5) >> 1


PAGES = (
    "row long, page_id string, url string, host string, content long, whole long, nodes array<long>, layouts array<long>, above array<array<long>>, owners array<long>, "
    "texts array<long>, own array<long>, values array<long>, lefts array<boolean>, marks array<boolean>, leads array<boolean>, said array<string>"
)


def pages_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(row, page_id, url, host, html) -> one row a page. content: the hash of its texts without declared noise; nodes with their
    layouts and the nodes above; texts with the nodes that own them, once each; own, values, lefts, marks, leads, said: node, text's
    hash, left by the prior, marked, heading, and text of the blocks that are not declared noise."""
    names = [c.split()[0] for c in PAGES.split(", ")]
    for part in parts:
        out = []
        for row, page, url, host, html in zip(part["row"], part["page_id"], part["url"], part["host"], part["html"]):
            found, nodes = parse(html)
            kept = judged(found)
            content, whole = xxhash.xxh64(seed=6), xxhash.xxh64(seed=7)
            for b, _, _ in kept:
                content.update(b.text + "\n")
            pairs = sorted({(b.node, _text(b.text)) for b in found})
            layouts = [xxhash.xxh64_intdigest("|".join(said), 4) >> 1 for said, _ in nodes.values()]
            whole.update(repr((list(zip(nodes, layouts)), pairs)))
            out.append(
                (row, page, url, host, content.intdigest() >> 1, whole.intdigest() >> 1, list(nodes), layouts, [a for _, a in nodes.values()], [n for n, _ in pairs], [t for _, t in pairs],
                 [b.node for b, _, _ in kept], [_text(b.text) for b, _, _ in kept], [left for _, left, _ in kept], [m for _, _, m in kept], [b.lead for b, _, _ in kept], [b.text for b, _, _ in kept])
            )
        if out:
            yield pd.DataFrame(out, columns=names)


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, node, kind, value, above) of the rows of pages_of(), copies of one page of a host once: layouts are kind 0, texts kind 1."""
    one = pages.groupBy("host", "content").agg(F.min_by("row", "whole").alias("row")).select("row")
    rows = pages.select("row", "host", "nodes", "layouts", "above", "owners", "texts").join(one, "row", "left_semi")
    kind = lambda k: F.lit(k).alias("kind")
    layouts = F.transform(F.arrays_zip("nodes", "layouts", "above"), lambda x: F.struct(x["nodes"].alias("node"), kind(0), x["layouts"].alias("value"), x["above"].alias("above")))
    texts = F.transform(F.arrays_zip("owners", "texts"), lambda x: F.struct(x["owners"].alias("node"), kind(1), x["texts"].alias("value"), F.lit(None).cast("array<long>").alias("above")))
    return rows.select("host", F.explode(F.concat(layouts, texts)).alias("x")).select("host", "x.*")


def counted(rows: DataFrame) -> DataFrame:
    """The rows of distinct_pages() with n, the number of pages that have them; above follows from node."""
    return rows.groupBy("host", "node", "kind", "value", "above").agg(F.count("*").alias("n"))


def importances(counts: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of the style trees of all hosts, from the rows of counted()."""
    layouts = counts.where("kind = 0").groupBy("host", "node", "above").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    several = F.col("m") > 1
    looks = layouts.withColumn("looks", F.when(several, 1 - F.col("nlogn") / (F.col("m") * F.log("m"))).otherwise(1.0))
    texts = counts.where("kind = 1").groupBy("host", "node").agg(F.count("*").alias("texts"), F.sum(F.log("n")).alias("logs"))
    total = F.when(several, F.col("texts") - F.col("logs") / F.log("m")).otherwise(F.col("texts"))
    leaf = looks.join(texts, ["host", "node"]).select("host", F.explode("above").alias("node"), total.alias("total"), "texts")
    below = leaf.groupBy("host", "node").agg((F.sum("total") / F.sum("texts")).alias("reads"))
    return looks.join(below, ["host", "node"]).select("host", "node", F.col("m").alias("pages"), ((1 - GAMMA) * F.col("looks") + GAMMA * F.col("reads")).alias("importance"))


def decided(pages: DataFrame) -> DataFrame:
    """(row, node, value) where the tree decides otherwise than the prior: on a node (value -1), or against a text of a node."""
    counts = written(counted(distinct_pages(pages)), "counts")
    known = written(importances(counts).where(F.col("pages") >= LEAST), "known")
    frequent = counts.where((F.col("kind") == 1) & (F.col("n") >= ALL * LEAST)).join(known, ["host", "node"])
    frequent = written(frequent.where(F.col("n") >= ALL * F.col("pages")).select("host", "node", "value"), "everywhere")
    blocks = pages.select("row", "host", F.explode(F.array_distinct(F.arrays_zip(F.col("own").alias("node"), F.col("values").alias("value"), F.col("lefts").alias("left"), F.col("marks").alias("marked")))).alias("b"))
    blocks = blocks.select("row", "host", "b.*")
    stays = F.col("importance") + F.when(F.col("marked"), RAISE).otherwise(0.0) >= CUT
    nodes = blocks.join(known, ["host", "node"]).where(stays != F.col("left")).select("row", "node", F.lit(-1).cast("long").alias("value")).distinct()
    return nodes.unionByName(blocks.join(frequent, ["host", "node", "value"]).select("row", "node", "value"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))
    given = small_batches(pages).select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("string").alias("page_id"), "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    rows = written(given.mapInPandas(pages_of, PAGES), "pages")
    turned = written(decided(rows).groupBy("row").agg(F.collect_list(F.struct("node", "value")).alias("turned")), "turned")  # its size decides the join

    @pandas_udf("string")
    def text(said: pd.Series, own: pd.Series, values: pd.Series, lefts: pd.Series, leads: pd.Series, turned: pd.Series) -> pd.Series:
        out = []
        for words, nodes, hashes, left, lead, t in zip(said, own, values, lefts, leads, turned):
            t = [] if t is None else t
            other, repeated = {x["node"] for x in t if x["value"] < 0}, {(x["node"], x["value"]) for x in t}
            kept = with_leads([k != (n in other) and (n, v) not in repeated for n, v, k in zip(nodes, hashes, left)], left, lead)
            out.append("\n\n".join(w for w, k in zip(words, kept) if k))
        return pd.Series(out, dtype=object)

    blocks = rows.select("row", "page_id", "url", "said", "own", "values", "lefts", "leads")
    joined = blocks.join(turned, "row", "left").withColumn("text", text.asNondeterministic()("said", "own", "values", "lefts", "leads", "turned"))
    return joined.select(F.col("page_id").cast(pages.schema["page_id"].dataType).alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
