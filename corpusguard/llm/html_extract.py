"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged by path: a branch of the tree is the list of
labels (tag, classes) from the root, whatever the page. Every element of every page
is in the tree, and so is text that stands beside elements. For each branch the tree
holds the distributions of its presentation (the labels inside it) and of its
content (the text inside it) over the host's pages; their entropies, each divided by
its largest possible value and weighted by ``CONTENT``, say how much the branch
differs from page to page. Where a host has few pages, its entropies are drawn
towards those of the same branch over all hosts (``SHRINK`` pages' worth), and these
towards a half, so the rule is the same for hosts of every size.

Importance is a posterior: prior odds by what labels say (``ODDS``), times the odds
of the entropy. A branch named as navigation, footer or advert, and one that stands
beside the page's article, is unlikely to be main text whatever its entropy; an
article is so whatever its entropy; a plain block is what its entropy says. Branches
below ``THRESHOLD`` are removed from each page, and the rest is its main text:
nothing but the tree removes anything that has text. Pages with an article, with a
main element, and with neither are different templates, so different branches.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.store import BROADCAST_KEYS, stored
from corpusguard.llm.url_filter import host_and_path

#: Branches of less importance are removed.
THRESHOLD = 0.3
CONTENT = 0.8
#: Pages that the entropies of the same branch elsewhere count as.
SHRINK = 8
#: An entropy's odds are at most this, and at least its inverse.
MOST_ODDS = 19.0
#: Prior odds of being main text: of branches that labels call noise or that stand
#: beside the article; of blocks; of blocks in the article; of elements that hold
#: text; and of the article and what is around it.
ODDS = {"noise": 0.01, "block": 1.0, "inner": 2.0, "text": 20.0, "article": 1e6}
#: Distinct counts that a task holds before it sends them on.
FLUSH = 200_000

#: What names of elements and words in their classes say.
NOISE_TAGS = frozenset(
    "aside button canvas dialog embed footer form frame frameset head iframe input map menu meta nav noframes noscript object option script select style svg template textarea title".split()
)
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr legal login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription toolbar widget widgets".split()
)
#: Words that are noise unless the element is inside an article or main element.
OUTER_WORDS, OUTER_TAGS = frozenset(["header", "topbar"]), frozenset(["header"])
NOISE_ROLES = frozenset("banner complementary contentinfo navigation search form dialog alert menu menubar".split())
ARTICLE_WORDS = frozenset("articlebody article-body article-content entry-content post-content post-body story-body".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that hold the text itself; they are no parts of a layout.
TEXT_TAGS = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption br hr body html".split())
#: Opening one of these closes an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Opening a key closes an open element of the values, up to one of the list.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: An end tag does not reach over these.
WALLS = frozenset(["table", "td", "th", "button", "object", "article"])

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)["']?[^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d{3,}")  # numbers of pages and posts


class Node:
    __slots__ = ("tag", "path", "noise", "kind", "judged", "inside", "chunk", "chunk_end", "labels", "labels_end")


class Paths:
    """64-bit hashes of paths and what labels say, remembered by label."""

    def __init__(self):
        self.paths: dict[tuple[int, str], int] = {}
        self.said: dict[tuple[str, str], tuple[str, bool, bool, str, bool]] = {}

    def path(self, parent: int, label: str) -> int:
        if (found := self.paths.get((parent, label))) is None:
            if len(self.paths) > 200_000:  # a cache of bounded size
                self.paths.clear()
            found = self.paths[parent, label] = xxhash.xxh64_intdigest(label, seed=parent) & (1 << 63) - 1
        return found

    def label(self, tag: str, rest: str) -> tuple[str, bool, bool, str, bool]:
        """Label; is it noise; is it noise outside of articles; article, main or
        neither; and is it a part of a layout that entropy may judge."""
        if (found := self.said.get((tag, rest))) is not None:
            return found
        said: dict[str, str] = {}
        for name, value in _ATTRIBUTE.findall(rest) if rest else ():
            said.setdefault(name.lower(), value.strip("\"'").lower())
        names = f"{said.get('class', '')} {said.get('id', '')}".split()
        words = {w for n in names for w in _WORD.findall(n)}
        role = said.get("role", "")
        body = bool(ARTICLE_WORDS & {*names, said.get("itemprop", "")})
        kind = "article" if tag == "article" or role == "article" or body else "main" if tag == "main" or role == "main" else ""
        hidden = "hidden" in said or said.get("aria-hidden") == "true"
        noise = tag in NOISE_TAGS or role in NOISE_ROLES or hidden or (bool(NOISE_WORDS & words) and tag not in ("body", "html") and not body)
        outer = tag in OUTER_TAGS or bool(OUTER_WORDS & words)
        name = _DIGITS.sub("#", ".".join([tag, *sorted(names), *([f"@{role}"] if role else []), *(["@hidden"] if hidden else [])]))
        found = name, noise, outer, kind, kind == "" and (tag not in TEXT_TAGS or (bool(names) and tag not in ("body", "html")))
        if len(self.said) > 50_000:
            self.said.clear()
        self.said[tag, rest] = found
        return found


def parse(page: str, paths: Paths) -> tuple[list[Node], list[tuple[str, Node | None]], list[str]]:
    """Nodes of a page in document order, its text in chunks with their nodes, and
    the nodes' labels. Tolerates what browsers do: unclosed and crossing elements,
    missing ends, stray brackets."""
    nodes: list[Node] = []
    chunks: list[tuple[str, Node | None]] = []
    labels: list[str] = []
    stack: list[Node] = []
    at, size = 0, len(page)

    def close(to: int) -> None:
        for node in stack[to:]:
            node.chunk_end, node.labels_end = len(chunks), len(labels)
        if any(n.tag not in INLINE for n in stack[to:]):
            chunks.append((" ", stack[to - 1] if to else None))
        del stack[to:]

    while at < size:
        found = _TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            chunks.append((html.unescape(text) if "&" in text else text, stack[-1] if stack else None))
        if not found:
            break
        at = found.end()
        slash, tag, rest = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in WALLS:
                    break
            else:
                if tag in ("p", "br"):
                    chunks.append((" ", stack[-1] if stack else None))
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in CLOSES:
            ends, walls = CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in ends:
                    close(i)
                    if tag != "tr" or (stack and stack[-1].tag in walls):
                        break
                elif stack[i].tag in walls:
                    break
        if tag in VOID:
            if tag not in INLINE:
                chunks.append((" ", stack[-1] if stack else None))
            continue
        label, noise, outer, kind, judged = paths.label(tag, rest)
        parent = stack[-1] if stack else None
        node = Node()
        node.tag, node.kind, node.judged = tag, kind, judged
        node.path = paths.path(parent.path if parent else 0, label)
        node.inside = kind or (parent.inside if parent else "")
        node.noise = noise or (outer and not (parent and parent.inside)) or bool(parent and parent.noise)
        if tag not in INLINE:
            chunks.append((" ", parent))
        node.chunk, node.labels = len(chunks), len(labels)
        node.chunk_end = node.labels_end = -1
        nodes.append(node)
        labels.append(label)
        if tag in RAW:  # its text is no markup; none of it is main text
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            close_at = page.find(">", end.end()) if end else -1
            at = close_at + 1 if close_at >= 0 else size
            node.chunk_end, node.labels_end = len(chunks), len(labels)
            continue
        if rest.endswith("/") and tag in ("svg", "path"):
            node.chunk_end, node.labels_end = len(chunks), len(labels)
            continue
        stack.append(node)
    for node in stack:
        node.chunk_end, node.labels_end = len(chunks), len(labels)
    return nodes, chunks, labels


_PRIME = (1 << 61) - 1
_BASE = 0x1E3779B97F4A7C15


class Runs:
    """Hashes of runs of a sequence of hashes, each in constant time."""

    def __init__(self, values: list[int]):
        self.sums = list(accumulate(values, lambda total, x: (total * _BASE + x) % _PRIME, initial=1))
        self.powers = list(accumulate(values, lambda power, _: power * _BASE % _PRIME, initial=1))

    def of(self, a: int, b: int) -> int:
        return (self.sums[b] - self.sums[a] * self.powers[b - a]) % _PRIME


class Page:
    """A page's branches: for each node, and each chunk of text that stands beside
    elements, the branch it belongs to and its prior odds."""

    def __init__(self, page: str, paths: Paths):
        self.nodes, self.chunks, self.labels = parse(page, paths)
        self.words = [c.split() for c, _ in self.chunks]
        template, found = self._regions()
        regions, starts = [(n.chunk, n.chunk_end) for n in found], [n.chunk for n in found]
        below = [n.labels for n in found]

        def beside(a: int, b: int) -> bool:
            """Does ``[a, b)`` hold no region and lie in none?"""
            if not regions:
                return False
            i = bisect_right(starts, a) - 1
            inside = i >= 0 and a < regions[i][1]
            return not inside and not (i + 1 < len(regions) and regions[i + 1][0] < b)

        self.keys, self.priors = [], []
        for node in self.nodes:
            around = bisect_right(below, node.labels) < bisect_right(below, node.labels_end - 1)
            if node.noise or (beside(node.chunk, node.chunk_end) and node.tag not in ("html", "body")):
                odds = "noise"
            elif node.kind or node.tag in ("html", "body") or around:
                odds = "article"
            elif node.judged:
                odds = "inner" if node.inside else "block"
            else:
                odds = "text"
            self.keys.append(node.path ^ template)
            self.priors.append(odds)
        self.loose: dict[int, tuple[int, str]] = {}  # chunks of text that are branches of their own
        for i, (_, parent) in enumerate(self.chunks):
            if self.words[i] and (parent is None or not (parent.noise or parent.tag in TEXT_TAGS - {"html", "body"})):
                path = paths.path(parent.path if parent else 0, "#text") ^ template
                self.loose[i] = path, "noise" if beside(i, i + 1) else "text"

    def _regions(self) -> tuple[int, list[Node]]:
        """The template's number, and its articles or main elements, of nested ones the outer."""
        quiet, stop = bytearray(len(self.chunks)), 0
        for node in self.nodes:
            if node.noise and node.chunk_end > max(stop, node.chunk):
                begin = max(stop, node.chunk)
                quiet[begin : node.chunk_end] = b"\x01" * (node.chunk_end - begin)
                stop = node.chunk_end
        loud = list(accumulate((bool(w) and not q for w, q in zip(self.words, quiet, strict=True)), initial=0))
        for number, kind in ((1, "article"), (2, "main")):
            found, end = [], 0
            for n in self.nodes:  # in document order, so one inside another comes later
                if n.kind == kind and not n.noise and n.chunk_end > end and loud[n.chunk_end] > loud[n.chunk]:
                    found.append(n)
                    end = n.chunk_end
            if found:
                return number, found
        return 0, []

    def branches(self) -> dict[int, tuple[int, int, float]]:
        """For each branch hashes of what it shows and of its text, and its prior
        odds. A path that occurs several times adds its hashes up and has the
        largest odds."""
        at = list(accumulate(map(bool, self.words), initial=0))
        text = Runs([xxhash.xxh64_intdigest(" ".join(w)) for w in self.words if w])
        shown = Runs([xxhash.xxh64_intdigest(x) for x in self.labels])
        found = [(k, shown.of(n.labels, n.labels_end), text.of(at[n.chunk], at[n.chunk_end]), o) for n, k, o in zip(self.nodes, self.keys, self.priors, strict=True)]
        found += [(k, 0, text.of(at[i], at[i] + 1), o) for i, (k, o) in self.loose.items()]
        out: dict[int, tuple[int, int, float]] = {}
        for key, a, b, odds in found:
            x, y, z = out.get(key, (0, 0, 0.0))
            out[key] = (x + a) % _PRIME, (y + b) % _PRIME, max(z, ODDS[odds])
        return out

    def main_text(self, low: frozenset[int] | set[int]) -> str:
        """The page's text without the branches of low importance."""
        dropped, stop = bytearray(len(self.chunks)), 0
        for node, key in zip(self.nodes, self.keys, strict=True):
            if key in low and node.chunk_end > max(stop, node.chunk):
                begin = max(stop, node.chunk)
                dropped[begin : node.chunk_end] = b"\x01" * (node.chunk_end - begin)
                stop = node.chunk_end
        for i, (key, _) in self.loose.items():
            if key in low:
                dropped[i] = 1
        return " ".join("".join(c if not gone else " " for (c, _), gone in zip(self.chunks, dropped, strict=True)).split())


def importance(entropy: float, odds: float) -> float:
    """The posterior of being main text; ``style_tree`` has the same as a column."""
    evidence = min(max(entropy / max(1 - entropy, 1e-9), 1 / MOST_ODDS), MOST_ODDS)
    return odds * evidence / (1 + odds * evidence)


def low_by_labels(page: str, paths: Paths) -> set[int]:
    """Branches that are removed from a page of which no entropy is known."""
    return {key for key, (_, _, odds) in Page(page, paths).branches().items() if importance(0.5, odds) < THRESHOLD}


def main_text(page: str, low: frozenset[int] | set[int], paths: Paths) -> str:
    return Page(page, paths).main_text(low)


def style_tree(pages: DataFrame) -> DataFrame:
    """``pages(site, html)`` → ``(site, path, importance)``, ``site`` a hash of the
    host. Counts are summed in tasks before they are shuffled, and no host's pages
    come together. The counts are written once, as a host's entropies and those of
    all hosts both start from them; pages would be parsed for each otherwise."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, seen = Paths(), Counter()

        def sent() -> pa.RecordBatch:
            columns = [*zip(*seen, strict=True), list(seen.values())]
            seen.clear()
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["site", "path", "kind", "value", "odds", "n"])

        for batch in batches:
            for site, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for path, (shown, text, odds) in (Page(page, paths).branches() if page else {}).items():
                    seen[site, path, 0, shown, odds] += 1
                    seen[site, path, 1, text, odds] += 1
                if len(seen) >= FLUSH:
                    yield sent()
        if seen:
            yield sent()

    counted = pages.select("site", "html").mapInArrow(count, "site long, path long, kind int, value long, odds double, n long")
    values = stored(counted.groupBy("site", "path", "kind", "value").agg(F.sum("n").alias("n"), F.max("odds").alias("odds")), "values")
    pages_of, spread = F.sum("n"), F.sum(F.col("n") * F.log("n"))
    entropy = F.when(pages_of > 1, (F.log(pages_of) - spread / pages_of) / F.log(pages_of)).otherwise(0.5)
    here = values.groupBy("site", "path", "kind").agg(pages_of.alias("m"), entropy.alias("entropy"), F.max("odds").alias("odds"))
    every = values.groupBy("path", "kind", "value").agg(F.sum("n").alias("n")).groupBy("path", "kind").agg(pages_of.alias("m_all"), entropy.alias("all"))
    # A page by itself says nothing of what its host repeats.
    n_all, n = F.col("m_all") - 1, F.col("m") - 1
    both = here.join(every, ["path", "kind"]).withColumn("all", (n_all * F.col("all") + SHRINK * 0.5) / (n_all + SHRINK))
    weight = F.when(F.col("kind") == 1, CONTENT).otherwise(1 - CONTENT)
    mean = F.sum(weight * (n * F.col("entropy") + SHRINK * F.col("all")) / (n + SHRINK))
    tree = both.groupBy("site", "path").agg(mean.alias("entropy"), F.max("odds").alias("odds"))
    evidence = F.least(F.greatest(F.col("entropy") / F.greatest(1 - F.col("entropy"), F.lit(1e-9)), F.lit(1 / MOST_ODDS)), F.lit(MOST_ODDS))
    return tree.select("site", "path", (F.col("odds") * evidence / (1 + F.col("odds") * evidence)).alias("importance"))


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, ...)`` → ``(page_id, url, text, n_chars)``.

    Null or empty html has the empty text. Character references are decoded; white
    space becomes one space, within blocks and between them. A null url, or one
    without a host, belongs to the host ''. Rows repeat as given, and other
    columns are ignored; an empty table gives no rows.
    """
    rows = pages.select("page_id", "url", F.xxhash64(host_and_path(F.col("url"))[0]).alias("site"), "html")
    low = stored(style_tree(rows).where(F.col("importance") < THRESHOLD).select("site", "path"), "low")
    # One string for a host's branches: equal strings are read once for a batch.
    by_site = low.groupBy("site").agg(F.concat_ws(" ", F.array_sort(F.collect_list(F.hex("path")))).alias("low"))
    by_site = F.broadcast(by_site) if low.count() <= BROADCAST_KEYS // 4 else by_site
    rows = rows.join(by_site, "site", "left").select("page_id", "url", "html", "low")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths()
        for batch in batches:
            coded = batch.column(3).dictionary_encode()
            lists = [frozenset(int(x, 16) for x in each.split()) for each in coded.dictionary.to_pylist()]
            out = [
                Page(page, paths).main_text(lists[number] if number is not None else frozenset()) if page else ""
                for page, number in zip(batch.column(2).to_pylist(), coded.indices.to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
