"""The main text of web pages, with site templates found by counting element subtrees per host.

A page is read once: tags open and close containers, the text between block tags becomes blocks, and each
container's subtree gets a hash of its tags, classes and text. A container holds a stretch of the page's blocks, so
pages of any depth take linear time. Spark counts around how many different main texts of a host each hash occurs
(copies of a page count once); containers that recur around ``LEAST_TEXTS`` of them, on hosts of any size, are site
templates and their blocks are deleted. What HTML itself marks as no main text (menus, footers, page headers, asides,
forms, scripts, adverts, notices, reader comments, by tag or role) goes on every page, recurring or not; what only its
class or id calls so goes unless it holds the article or, on pages without one, most of the text. A name counts only
if all its parts are known (ad-box, but neither no-sidebar nor share-price), and names alone never empty a page.

The blocks in articles are the text, unless a main element holds more text beside them than they have (teasers);
there only boxes, never paragraphs, headings or list items, can be templates, and never a subtree with more than
half of the page's text.

A null or empty page has an empty text. Pages of one id and one content get equal texts.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.skew import join_per_key
from sieveline.session import materialise

#: A subtree is a template where it stands around so many different main texts of its host.
LEAST_TEXTS = 5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+'|['\"])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# What HTML calls its elements.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math select object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOXES = frozenset("div section nav aside header footer form ul ol dl table figure fieldset details dialog menu main article center".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre tr td th caption figcaption address summary tbody thead tfoot body html head hgroup legend option".split())
BREAKS = BOXES | FLOW | frozenset(("br", "hr"))
DROPPED_TAGS = frozenset("nav aside footer form head menu dialog button".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
CLOSES_PARAGRAPH = BOXES | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre address hr".split())
SAME_LEVEL = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Names of what is no main text, words that stand beside them in a name, and names of two words.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead"
    " cookie cookies consent gdpr notice newsletter subscribe signup popup modal banner comment comments disqus respond social share sharing related recommended pagination toolbar".split()
)
BESIDE = frozenset(
    "site page post article main primary secondary top bottom left right inner outer box bar block list item items link links container wrapper wrap area section widget panel column"
    " form button buttons icon icons posts articles stories content unit slot zone region group header body text title reader readers user users js".split()
)
NAMED_PAIRS = frozenset("site-header page-header side-bar skip-link skip-links".split())


def named(value: str) -> bool:
    """Whether a class or id calls its element something that is no main text."""
    for token in value.lower().split():
        parts = [x for x in re.split("[-_]+", token) if x]
        if "-".join(parts) in NAMED_PAIRS or (any(x in NAMES for x in parts) and all(x in NAMES or x in BESIDE or x.isdigit() for x in parts)):
            return True
    return False


def dropped(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is no main text whatever it holds; ``inside`` an article or main element headers are its own."""
    if tag in DROPPED_TAGS or attributes.get("role", "").lower() in DROPPED_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return tag == "header" and not inside


class Page:
    """One page as blocks of text and boxes, each box a stretch of blocks with the hash of its subtree."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, bool, bool]] = []  # text, dropped, in an article, in a main element
        self.boxes: list[list[int]] = []  # [hash, first block, block behind]
        self.names: list[list] = []  # elements that only a name drops: [first block, block behind, in or with an article]
        self.stack: list[tuple] = []  # (tag, box or -1, dropped, in article, in main, name or -1, articles before)
        self.count: dict[str, int] = {}  # of each tag that is open
        self.hashers: list = []  # of the open boxes
        self.text: list[str] = []
        self.articles = 0
        self.read(source)

    def read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = TOKEN.search(source, at)
            if not found:
                self.text.append(source[at:])
                break
            self.text.append(source[at : found.start()])
            at = found.end()
            tag = found[2]
            if tag is None:
                continue
            tag = tag.lower()
            if found[1]:
                self.close(tag)
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else end
            else:
                self.open(tag, found[3])
        self.block()
        while self.stack:
            self.pop()

    def top(self) -> tuple:
        return self.stack[-1] if self.stack else ("", -1, False, False, False, -1, 0)

    def block(self) -> None:
        """End the block that is being read."""
        if not self.text:
            return
        text = " ".join(html.unescape("".join(self.text)).split())
        self.text = []
        if text:
            self.blocks.append((text, *self.top()[2:5]))
            if self.hashers:
                self.hashers[-1].update(text.encode("utf-8", "replace") + b"\0")

    def open(self, tag: str, raw: str) -> None:
        if tag not in BREAKS:
            if tag not in DROPPED_TAGS:
                return
        self.block()
        if tag in CLOSES_PARAGRAPH and self.count.get("p"):
            self.close_until("p", BOXES)
        if tag in SAME_LEVEL and self.count.get(tag):
            self.close_until(tag, SAME_LEVEL[tag])
        if tag in VOID:
            return
        attributes: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(raw) if raw else ():
            attributes.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        _, _, gone, article, main, _, _ = self.top()
        gone = gone or dropped(tag, attributes, article or main)
        name = -1
        if tag not in ("html", "body", "article", "main") and not gone and (named(attributes.get("class", "")) or named(attributes.get("id", ""))):
            name = len(self.names)
            self.names.append([len(self.blocks), 0, article or main])
        before = self.articles
        if tag in ("article", "main"):
            self.articles += 1
            article, main = article or tag == "article", main or tag == "main"
        box = -1
        mark = f"<{tag} {attributes.get('class', '')} {attributes.get('id', '')}>".encode("utf-8", "replace")
        if self.hashers:
            self.hashers[-1].update(mark)
        if tag in BOXES and tag not in ("article", "main"):
            box = len(self.boxes)
            self.hashers.append(xxhash.xxh64(mark))
            self.boxes.append([0, len(self.blocks), 0])
        self.stack.append((tag, box, gone, article, main, name, before))
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop(self) -> None:
        tag, box, _, _, _, name, before = self.stack.pop()
        self.count[tag] -= 1
        if box >= 0:
            own = self.hashers.pop()
            self.boxes[box][0] = own.intdigest() - (1 << 63)
            self.boxes[box][2] = len(self.blocks)
            if self.hashers:  # a box's hash is made of those of the boxes in it
                self.hashers[-1].update(own.digest())
        if name >= 0:
            self.names[name][1] = len(self.blocks)
            if self.articles > before:
                self.names[name][1] = self.names[name][0]  # it holds the article

    def close_until(self, tag: str, stops) -> None:
        """Close the innermost open ``tag``, but not beyond one of ``stops``."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k][0] in stops:
                return

    def close(self, tag: str) -> None:
        if tag not in BREAKS and tag not in DROPPED_TAGS:
            return
        self.block()
        if self.count.get(tag):
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def main(self) -> np.ndarray:
        """Which blocks are main text."""
        n = len(self.blocks)
        size = np.array([len(b[0]) for b in self.blocks], dtype=np.int64)
        flags = np.array([b[1:] for b in self.blocks], dtype=bool).reshape(n, 3)
        live, article, main = ~flags[:, 0], flags[:, 1], flags[:, 2]
        before = np.concatenate([[0], np.cumsum(size * live)])
        # What names call no main text: beside an article always, else when it is no more than half.
        cover = np.zeros(n + 1, dtype=np.int64)
        for first, behind, inside in self.names:
            if inside or self.articles or 2 * (before[behind] - before[first]) <= before[-1]:
                cover[first] += 1
                cover[behind] -= 1
        plain = np.cumsum(cover[:-1]) == 0
        for good in (live & plain, live):
            if (size * (good & article)).sum() * 2 >= (size * (good & (article | main))).sum() > 0:
                return good & article
            if (good & main).any():
                return good & main
            if (good & article).any():
                return good & article
            if good.any() and not (self.articles and (live & (article | main)).any()):
                return good
        return live

    def kept(self) -> tuple[list[str], list[list[int]]]:
        """The blocks of the main text, and the boxes around them that could be templates: [hash, first, behind]."""
        mine = self.main()
        live = np.array([not b[1] for b in self.blocks], dtype=bool)
        before = np.concatenate([[0], np.cumsum([len(b[0]) if ok else 0 for b, ok in zip(self.blocks, live)])])
        place = np.concatenate([[0], np.cumsum(mine)]).astype(int)
        boxes = [
            [h, int(place[a]), int(place[b])] for h, a, b in self.boxes if place[a] < place[b] and 2 * (before[b] - before[a]) <= before[-1]
        ]
        return [b[0] for b, ok in zip(self.blocks, mine) if ok], boxes

    def rests(self) -> tuple[int, dict[int, int]]:
        """A hash of the main text, and for each box's hash that of the main text without such boxes."""
        mine = self.main()
        sums = [0]
        for b, ok in zip(self.blocks, mine):
            sums.append(sums[-1] + (xxhash.xxh64_intdigest(b[0].encode("utf-8", "replace")) if ok else 0))
        inside: dict[int, int] = {}
        for h, a, b in self.boxes:
            inside[h] = inside.get(h, 0) + sums[b] - sums[a]
        signed = lambda x: x % (1 << 64) - (1 << 63)
        return signed(sums[-1]), {h: signed(sums[-1] - x) for h, x in inside.items()}


def host_of(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def parsed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """_id, _url, key (equal pages have one), host, texts, boxes (hash, first text, text behind), hashes (of the page), rests
    (hash of the main text without each of them)."""
    box = pa.struct([("hash", pa.int64()), ("first", pa.int64()), ("behind", pa.int64())])

    def work(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for url, source in zip(batch.column(1).to_pylist(), batch.column(2)):
                page = Page(source.as_py() or "")
                texts, boxes = page.kept()
                _, rests = page.rests()
                for k, v in enumerate((host_of(url or ""), texts, [dict(zip(("hash", "first", "behind"), b)) for b in boxes], list(rests), list(rests.values()))):
                    out[k].append(v)
            kinds = (pa.string(), pa.list_(pa.string()), pa.list_(box), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), *(pa.array(v, k) for v, k in zip(out, kinds))],
                names=["_id", "_url", "key", "host", "texts", "boxes", "hashes", "rests"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html")).withColumn("key", F.xxhash64("_id", "_url", "_html"))
    boxes = "array<struct<hash:long,first:long,behind:long>>"
    return rows.mapInArrow(work, f"_id long, _url string, key long, host string, texts array<string>, boxes {boxes}, hashes array<bigint>, rests array<bigint>")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_TEXTS) -> DataFrame:
    """One row per row: _id, _url, text (blocks joined by one space), n_chars."""
    parsed = materialise(parsed_pages(pages, id_col, url_col, html_col))
    # Copies of a page count once, so what they share isn't a template for their number. Distinct rows first, then counts:
    # no task holds a host's or a box's contents.
    around = parsed.select("host", F.explode(F.arrays_zip("hashes", "rests")).alias("b")).select("host", F.col("b.hashes").alias("hash"), F.col("b.rests").alias("rest")).distinct()
    templates = around.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    # Only boxes around main text matter now; pages without any have nothing to lose and stay where they are.
    boxed = F.size("boxes") > 0
    asked = parsed.filter(boxed).select("key", "host", F.explode(F.array_distinct(F.transform("boxes", lambda b: b["hash"]))).alias("hash"))
    gone = join_per_key(asked, templates, ["host", "hash"], "_n").groupBy("key").agg(F.collect_set("hash").alias("gone"))
    # Boxes come in the order they open, so of nested ones the outermost is first.
    found = F.filter("boxes", lambda b: F.array_contains("gone", b["hash"]))
    outermost = F.aggregate(
        found, F.slice("boxes", 1, 0), lambda seen, b: F.when(b["behind"] > F.coalesce(F.get(seen, F.size(seen) - 1)["behind"], F.lit(0)), F.concat(seen, F.array(b))).otherwise(seen)
    )
    kept = F.filter("texts", lambda _, i: ~F.exists("_out", lambda b: (b["first"] <= i) & (i < b["behind"])))
    whole = parsed.filter(~boxed).select("_id", "_url", F.array_join("texts", " ").alias("text"))
    cut = parsed.filter(boxed).join(gone, "key", "left").withColumn("_out", F.when(F.col("gone").isNotNull(), outermost).otherwise(F.slice("boxes", 1, 0)))
    return whole.unionByName(cut.select("_id", "_url", F.array_join(kept, " ").alias("text"))).withColumn("n_chars", F.length("text").cast("long"))
