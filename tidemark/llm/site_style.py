"""Main text of pages by site style trees.

Each page is parsed once into blocks: text, path of its style node (tags and classes from the root) and parent. Pages of one host are
merged into one tree, as counts of (host, path, content) and (host, parent, child sequence), each once a page; a node's content on a page
is all its texts there, in order. From them: content importance = entropy of the node's contents over log(pages that have it), 1 for a
node of one page; presentation importance = the same for the child sequences of
its parent; a node's importance weighs them GAMMA to 1 - GAMMA. Nodes under LOW are removed from every page of the host. Elements that are no main text by meaning (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, comments) are left out while parsing. Article and main elements are nodes like any other:
blocks inside and outside them are counted, and importance decides on both. A page that would lose all its blocks keeps them.

Counts are pre-aggregated, so a host of any size is never in one task. Row semantics: each row is extracted by itself; null or empty html
gives an empty text; a null or malformed url is a host of its own name ''. Texts and pages have no caps. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, settle

LOW, GAMMA = 0.2, 0.9
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = set("head script style noscript template svg nav footer aside form button select option textarea iframe object dialog menu canvas audio video".split())
BLOCK = set("html body main article section header div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address hr details summary fieldset center".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert".split())
NOISE = re.compile(r"(?i)(^|[-_\s])(ad|ads|advert\w*|banner|sponsor\w*|promo\w*|sidebar|aside|nav\w*|menu|breadcrumbs?|header|masthead|footer|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|comments?|respond|share|social|related|widget|toolbar|pagination)($|[-_\s\d])")
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table article main section div body aside nav footer header form blockquote".split())


class _Page(HTMLParser):
    """Blocks as [path, parent path, text]; and the child sequence of each parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # tag, path, left out, in article
        self.blocks: list[tuple[str, str, str]] = []
        self.children: dict[str, list[str]] = {}
        self.text: list[str] = []

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            inner = [x for x in self.open if x[0] in BLOCK or not x[0]]
            path = inner[-1][1]
            self.blocks.append((path, path.rpartition("/")[0], text))

    def _close(self, at: int):
        if any(x[0] in BLOCK for x in self.open[at:]):
            self.flush()
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCK:
            self.flush()
            ends = CLOSED_BY.get(tag, set()) | {"p"}
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at][0] in ends:
                    self._close(at)
                    break
                if self.open[at][0] in SCOPE:
                    break
        if tag in VOID:
            return
        _, path, out, inside = self.open[-1]
        a = {k: v or "" for k, v in attrs}
        kind = f"{a.get('class', '')} {a.get('id', '')}".strip()
        name = f"{tag}.{'.'.join(sorted(a.get('class', '').split()))}" if a.get("class") else tag
        noise = tag in NO_TEXT or (tag == "header" and not inside) or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true"
        noise = noise or (tag not in ("html", "body", "article", "main") and bool(NOISE.search(kind)))
        if tag in BLOCK:
            self.children.setdefault(path, []).append(name)
            path = f"{path}/{name}"
        self.open.append((tag, path, out or noise, inside or tag in ("article", "main")))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                self._close(at)
                return
            if tag not in BLOCK and tag not in NO_TEXT and self.open[at][0] in BLOCK:
                return

    def handle_data(self, data):
        if not self.open[-1][2]:
            self.text.append(data)


def _short(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def parse(html: str | None):
    """(blocks: [(path, text)], nodes: [(path, parent, content)], parents: [(path, child sequence)]) as hashes."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    texts: dict[tuple[str, str], list[str]] = {}
    for p, q, t in page.blocks:
        texts.setdefault((p, q), []).append(t)
    blocks = [{"path": _short(p), "text": t} for p, _, t in page.blocks]
    nodes = [{"path": _short(p), "parent": _short(q), "h": _short("\n".join(ts))} for (p, q), ts in texts.items()]
    return blocks, nodes, [{"path": _short(p), "h": _short("\n".join(c))} for p, c in page.children.items()]


def _importance(counts: DataFrame) -> DataFrame:
    """(host, path, m, e) from (host, path, h, n): entropy of the contents over log m, m the pages."""
    x = counts.groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    return x.select("host", "path", "m", F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0).alias("e"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    node = "struct<path:long,parent:long,h:long>"

    def run(batches):
        for b in batches:
            got = [parse(h) for h in b.column(1).to_pylist()]
            blocks = pa.array([x for x, _, _ in got], pa.list_(pa.struct([("path", pa.int64()), ("text", pa.string())])))
            nodes = pa.array([x for _, x, _ in got], pa.list_(pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("h", pa.int64())])))
            parents = pa.array([x for _, _, x in got], pa.list_(pa.struct([("path", pa.int64()), ("h", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), blocks, nodes, parents], names=["key", "blocks", "nodes", "parents"])

    host = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    plain = pages.select(F.struct("page_id", "url", host.alias("host")).alias("key"), "html")
    key = plain.schema["key"].dataType.simpleString()
    parsed = settle(plain.mapInArrow(run, f"key {key}, blocks array<struct<path:long,text:string>>, nodes array<{node}>, parents array<struct<path:long,h:long>>").select("key.*", "blocks", "nodes", "parents"), "pages")
    each = parsed.select("host", F.explode("nodes").alias("x")).select("host", "x.*")
    contents = _importance(each.groupBy("host", "path", "h").agg(F.count("*").alias("n")))
    parent = each.groupBy("host", "path").agg(F.min("parent").alias("parent"))
    shapes = _importance(parsed.select("host", F.explode("parents").alias("x")).select("host", "x.*").groupBy("host", "path", "h").agg(F.count("*").alias("n")))
    both = contents.join(parent, ["host", "path"]).join(shapes.select("host", F.col("path").alias("parent"), F.col("e").alias("pe")), ["host", "parent"], "left")
    scored = both.select("host", "path", (GAMMA * F.col("e") + (1 - GAMMA) * F.coalesce("pe", F.lit(1.0))).alias("importance"))
    low = settle(scored.where(F.col("importance") < LOW).select("host", "path"), "low-nodes")
    host_low = low.groupBy("host").agg(F.collect_set("path").alias("bad"))
    if low.agg(F.coalesce(F.sum(F.octet_length("host") + 16), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        host_low = F.broadcast(host_low)
    out = parsed.select("host", "page_id", "url", "blocks").join(host_low, "host", "left")
    kept = F.filter("blocks", lambda x: F.col("bad").isNull() | ~F.array_contains("bad", x.path))
    text = F.concat_ws("\n\n", F.transform(F.when(F.size(kept) > 0, kept).otherwise(F.col("blocks")), lambda x: x.text))
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
