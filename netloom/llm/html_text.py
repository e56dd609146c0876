"""The main text of web pages as a maximum-scoring subsequence.

A page is a sequence of tags and runs of words. Words score ``WORD`` each where their
containers hold content; where they hold menus, adverts and the like they cost ``OTHER_WORD``;
a tag costs what it tells against content, in units of ``TAG``. An advert between paragraphs
is thus bridged, a list of links beside the content is not. The contiguous part with the highest sum, found by one
linear scan, is the content region; of it the words of content containers are given out, block
by block.

The weights are learned from labelled pages: pages that mark their content themselves
(``<article>`` or ``<main>``). Every container (tag name, with its class names where it has
any) gets the log-odds of its words lying outside, every tag name that of its occurrences.
Containers whose names speak against content (adverts, comments, ...) are outside within the
article too. A container is judged by the words that do not lie in deeper ones of these or in a
marked one; what holds the marked content on most of its pages is never judged. A
bounded sample of ``PAGES`` pages is used; what a sample lacks rests on prior counts by the
names that HTML itself gives such containers.

Defined cases: null or empty html gives an empty text. Unclosed and crossing tags are closed
with their parent. Unknown character references stay as they are. Extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import add_columns

PAGES = 300
WORD, OTHER_WORD, TAG = 1.0, 0.1, 0.25
#: Log-odds of lying outside from which a container holds no content.
OUTSIDE = 1.0
#: Words that a prior stands for.
PRIOR = 50.0

# Element names of HTML.
#: Elements of text only, ended by nothing but their own end tag; and elements that are left out with all tags in them.
RAW = {"script", "style", "textarea", "iframe", "xmp", "noembed", "noframes"}
LEFT_OUT = {"noscript", "template", "svg", "video", "audio"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend",
    "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
NOT_CONTENT = {"head", "title", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "label", "fieldset", "legend", "datalist"}
CONTENT = {"article", "main"}
#: Where these stand around a marked container, it is no content (teasers of other pages).
BESIDE = {"nav", "aside", "footer", "menu", "dialog"}
#: Parts of class names and ids of what is not content (fixed values, prior only).
NAMES = re.compile(
    r"(?:^|(?<!with)(?<!has)[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|"
    r"notice|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget|disqus|replies|alert)(?:$|[\s_-])",
    re.IGNORECASE,
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_BLANK = re.compile(r"\s+")


_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("open" | "close" | "text", tag name, attributes or text); raw and left-out elements and comments are not given."""
    at, skip, depth = 0, "", 0
    while m := _TOKEN.search(page, at):
        if m.start() > at and not skip:
            yield "text", "", page[at : m.start()]
        at = m.end()
        name = (m[2] or "").lower()
        if name in RAW:
            if not m[1]:
                end = _RAW_END[name].search(page, at)
                if end or not m[3].endswith("/"):
                    at = end.end() if end else len(page)
        elif skip:
            if name == skip and not m[3].endswith("/"):
                depth += -1 if m[1] else 1
                skip = skip if depth else ""
        elif name in LEFT_OUT:
            if not m[1] and not m[3].endswith("/"):
                skip, depth = name, 1
        elif name:
            yield ("close", name, "") if m[1] else ("open", name, m[3])
    if not skip and at < len(page):
        yield "text", "", page[at:]


def container(name: str, attributes: str) -> tuple[str, bool]:
    """The key of a container, and whether its names speak against content."""
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes)} if attributes else {}
    words = sorted(set(named.get("class", "").lower().split()))
    against = name in NOT_CONTENT or bool(named and name not in CONTENT | {"body", "html"} and any(NAMES.search(v) for v in named.values()))
    return ".".join([name, *words]), against


@dataclass
class Weights:
    words: dict[str, list[float]] = field(default_factory=dict)  # container -> words inside, outside the marked content
    tags: dict[str, list[float]] = field(default_factory=dict)  # tag name -> occurrences inside, outside
    holds: dict[str, list[float]] = field(default_factory=dict)  # container -> pages where it holds the marked content, others

    def outside(self, key: str, against: bool) -> float:
        """Log-odds that words of the container are no content."""
        inside, out = self.words.get(key, (0.0, 0.0))
        return math.log((out + 1 + PRIOR * against) / (inside + 1 + PRIOR * (not against)))

    def flagged(self, name: str, attributes: str) -> bool:
        """Whether a container holds no content."""
        key, against = container(name, attributes)
        holding, other = self.holds.get(key, (0.0, 0.0))
        return name not in ("html", "body") and holding <= other and self.outside(key, against) > OUTSIDE

    def cost(self, name: str) -> float:
        inside, out = self.tags.get(name, (0.0, 0.0))
        return TAG * max(0.1, math.log((out + 1) / (inside + 1)))


def learned(counts: list[tuple[str, str, float, float]]) -> Weights:
    """From (kind, name, inside, outside), kind ``words``, ``tags`` or ``holds``."""
    found = Weights()
    for kind, name, inside, out in counts:
        getattr(found, kind)[name] = [inside, out]
    return found


def counted(page: str) -> Counter:
    """(kind, name, inside) -> how many, of a page that marks its content."""
    out: Counter = Counter()
    stack: list[tuple[str, str, bool, bool]] = []  # name, key, against, marked
    seen, holding = set(), set()
    for kind, name, rest in tokens(page):
        if kind == "text":
            n = len(rest.split())
            if n:
                keys, inside = _own(stack)
                for key in keys:
                    out["words", key, inside] += n
            continue
        if name not in CONTENT:
            out["tags", name, _own(stack)[1]] += 1
        if kind == "open" and name not in VOID:
            key, against = container(name, rest)
            if name == "header" and _own(stack)[1]:
                against = False  # an article's own heading
            marked = name in CONTENT and not any(x[0] in BESIDE for x in stack)
            if marked:
                holding.update(x[1] for x in stack)
            seen.add(key)
            stack.append((name, key, against, marked))
        elif kind == "close":
            _closed(stack, name, key=lambda entry: entry[0])
    for key in seen:
        out["holds", key, key in holding] += 1
    return out


def _own(stack: list[tuple[str, str, bool, bool]]) -> tuple[set[str], bool]:
    """The containers that words here tell about, up to the first that is against content or marked; whether it is marked."""
    keys = set()
    for _, key, against, marked in reversed(stack):
        keys.add(key)
        if against or marked:
            return keys, marked and not against
    return keys, False


#: A tag of these closes an open one of the same kind (fixed values).
_CLOSES_OWN = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}


def _closed(stack: list, name: str, key=lambda entry: entry.split(".")[0]) -> list:
    """Takes the entries from the last ``name`` on off the stack; nothing if it isn't open."""
    for i in range(len(stack) - 1, -1, -1):
        if key(stack[i]) == name:
            gone = stack[i:]
            del stack[i:]
            return gone
    return []


def extracted(page: str | None, weights: Weights) -> str:
    """The main text: one line per block."""
    if not page:
        return ""
    pieces: list[tuple[float, str | None, bool]] = []  # score, text (None: a block's edge), content
    stack: list[tuple[str, int]] = []  # name, flagged containers around it
    bad = 0
    for kind, name, rest in tokens(page):
        if kind == "text":
            n = len(rest.split())
            pieces.append((0.0 if not n else -OTHER_WORD * n if bad else WORD * n, rest, not bad))
            continue
        edge = None if name in BLOCKS else " " if name == "br" else ""
        if kind == "open":
            if name == "p" or name in _CLOSES_OWN and stack and stack[-1][0] == name:
                # an open paragraph ends here, with what is open inside it, unless a container lies between
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        bad = stack[i][1]
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCKS:
                        break
            if name not in VOID:
                stack.append((name, bad))
                if name in CONTENT and not any(x in BESIDE for x, _ in stack):
                    bad = 0  # what stands around the marked content has no say in it
                else:
                    bad += weights.flagged(name, rest)
        elif gone := _closed(stack, name, key=lambda entry: entry[0]):
            bad = gone[0][1]
        pieces.append((-weights.cost(name), edge, not bad))
    first, last = best_region([score for score, _, _ in pieces])
    blocks, now = [], []
    for _, text, good in pieces[first:last]:
        if text is None:
            blocks.append("".join(now))
            now = []
        elif good:
            now.append(text)
    blocks.append("".join(now))
    lines = (_BLANK.sub(" ", html.unescape(b)).strip() for b in blocks)
    return "\n".join(line for line in lines if line)


def best_region(scores: list[float]) -> tuple[int, int]:
    """[first, last) of the contiguous part with the highest positive sum, the earliest of equals."""
    best, place, total, begin = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, place = total, (begin, i + 1)
    return place


def trained(pages: DataFrame, sample: int = PAGES) -> Weights:
    """Weights from about ``sample`` pages that mark their content; the counts are summed by Spark."""
    marked = pages.select("html").where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    few = marked.sample(fraction=min(1.0, 4.0 * sample / max(1, pages.count())), seed=13).limit(sample)

    def run(batches):
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column("html"):
                total += counted(page.as_py())
            rows = [(kind, name, float(n if inside else 0), float(0 if inside else n)) for (kind, name, inside), n in total.items()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "name", "inside", "out"])

    counts = few.mapInArrow(run, "kind string, name string, inside double, out double")
    summed = counts.groupBy("kind", "name").agg(F.sum("inside").alias("inside"), F.sum("out").alias("out"))
    return learned([tuple(r) for r in summed.collect()])  # names in at most ``sample`` pages


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, url, text."""
    sent = pages.sparkSession.sparkContext.broadcast(weights or trained(pages))
    of_batch = lambda batch: [[extracted(p.as_py(), sent.value) for p in batch.column("html")]]
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        add_columns({"text": pa.string()}, of_batch, ["html"]), "page_id long, url string, text string"
    )
