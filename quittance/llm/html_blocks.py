"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. A block is described by its
words and link density, those of the blocks before and after it, and where it stands: inside or
outside an article, and how surely an element around it is one for menus, headers, footers and the
like, by its name, role or class. A class, an id or a form says so only in part: an element that
holds the page's article, or most of its words, counts the less the larger its share of the words
is (``_graded``). A decision tree fitted to a small labelled table
(``labelled_blocks``) decides which blocks are main text, all blocks of a batch at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quittance.llm.labelled_blocks import TABLE
from quittance.llm.shared import ship, slices

# A tag with quoted attributes; one whose quotes do not close ends at the next bracket.
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"""
    r"""<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)"""
    r"""(?:(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<broken>[^>]*)(?:>|\Z))""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([A-Za-z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content is no text of the page. Without an end tag, the first ones take the rest
#: of the page, as in a browser; the others end with their parent or before the next block.
TO_THE_END = frozenset("script style title textarea".split())
RAW = TO_THE_END | frozenset("noscript template svg iframe object canvas select annotation annotation-xml".split())
#: Elements that start and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend "
    "li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and roles for what surrounds a text.
AROUND = frozenset("nav aside dialog head button label menu footer".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split()
)
#: Words in classes and ids that speak of it.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations sidebar aside widget menu nav navbar "
    "navigation breadcrumb breadcrumbs masthead topbar footer foot copyright legal disclaimer comment "
    "comments reply replies respond disqus discussion toolbar pagination pager search form skip logo "
    "brand tagline teaser teasers".split()
)
#: Beginnings and ends of such words written together with others, as in commentlist or pagefooter.
STEMS = (
    "advert", "banner", "breadcrumb", "comment", "consent", "cookie", "footer", "masthead",
    "navigation", "newsletter", "pagination", "sidebar", "sponsor", "subscri",
)
#: Class names for a state or a topic, which do not say what an element is for.
_STATE = re.compile(
    r"(?<!\S)(?:has|no|with|without|category|tag)[-_]\S*|\S+[-_](?:open|opened|closed|enabled|disabled|on|off)(?!\S)",
    re.IGNORECASE,
)
FEATURES = (
    "words",
    "link_density",
    "words_before",
    "link_density_before",
    "words_after",
    "link_density_after",
    "inside",  # an article
    "outside",  # the article that the page has
    "around",  # from 0 to 1
    "heading",
)
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_CLOSING = _HEADINGS | {"p", "li", "td", "th", "tr", "dd", "dt", "option"}


#: What an element may be: none of what surrounds a text, perhaps, surely.
NOT, HINTED, SURELY = 0, 1, 2


def _surrounds(name: str, attributes: dict[str, str], within: bool) -> int:
    """Whether an element is for what surrounds a text; ``within``: it stands in an article."""
    if name in AROUND or name == "header" and not within:
        return SURELY
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes:
        return SURELY
    if attributes.get("aria-hidden", "").lower() == "true":
        return SURELY
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return SURELY
    if name in ("html", "body", "main"):
        return NOT
    if name == "form":
        return HINTED
    named = _STATE.sub(" ", f"{attributes.get('class', '')} {attributes.get('id', '')}")
    found = {w.lower() for w in _WORD.findall(named)}
    if found & HINTS or not within and "header" in found:
        return HINTED
    return HINTED if any(w.startswith(STEMS) or w.endswith(STEMS) for w in found) else NOT


def _graded(rows: list[list[float]], elements: list[tuple[int, bool]]) -> list[float]:
    """How surely, from 0 to 1, each block stands in something that surrounds the text.

    A row is (words, link density, within, surely around, heading, its nearest hinted element or
    -1); an element is (the next hinted one around it or -1, whether it stands in an article). A
    hinted element counts in full, unless it holds most of the words of the page's articles, or
    most of the page's words, and there is no running text to speak of without it.
    """
    if not elements:
        return [row[3] for row in rows]
    words, articles = [0] * len(elements), [0] * len(elements)
    total = article = text = article_text = 0
    for n, links, within, surely, heading, e in rows:
        if surely:
            continue
        total += n
        article += n * within
        if e < 0 and n >= 10 and links < 0.5 and not heading:
            text += n
            article_text += n * within
        if e >= 0:
            words[e] += n
            articles[e] += n * within
    for e in range(len(elements) - 1, 0, -1):  # inner ones come last
        if (outer := elements[e][0]) >= 0:
            words[outer] += words[e]
            articles[outer] += articles[e]
    grades: list[float] = []
    for e, (outer, inside) in enumerate(elements):  # outer ones come first
        grade, share = 1.0, words[e] / max(1, total)
        if not article_text:
            if not inside and 2 * articles[e] > article:
                grade = min(0.5, 1 - share)
            elif words[e] >= 20 and share >= 0.5 and 4 * text <= words[e]:
                grade = 1 - share
        grades.append(max(grade, grades[outer] if outer >= 0 else 0.0))
    return [1.0 if row[3] else grades[row[5]] if row[5] >= 0 else 0.0 for row in rows]


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    return {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)}


class _Page:
    """Walks a page's markup and gathers its blocks."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.rows: list[list[float]] = []
        # name, inside an article, in something that surely surrounds, heading, hinted element
        self.stack: list[tuple[str, bool, bool, bool, int]] = [("", False, False, False, -1)]
        self.depths: Counter[str] = Counter()  # elements of the stack by name
        self.hinted: list[tuple[int, bool]] = []
        self.held: list[tuple[str, bool]] = []
        self.link: int | None = None

    def text(self, raw: str) -> None:
        if raw:
            self.held.append((unescape(raw) if "&" in raw else raw, self.link is not None))

    def close_block(self) -> None:
        if not self.held:
            return
        text = " ".join("".join(t for t, _ in self.held).split())
        if text:
            words = text.count(" ") + 1
            linked = sum(len(t.split()) for t, link in self.held if link)
            self.texts.append(text)
            self.rows.append([words, min(1.0, linked / words), *self.stack[-1][1:]])
        self.held = []

    def open(self, name: str, attributes: str) -> None:
        if name == "a":
            self.link = len(self.stack)
        elif name == "br":
            self.held.append((" ", False))
        if name not in BLOCK:
            return
        self.close_block()
        if name in VOID:
            return
        if self.stack[-1][0] == "head" or name in _CLOSING:
            self._close_open(name)
        _, within, around, heading, hinted = self.stack[-1]
        kind = _surrounds(name, _attributes(attributes), within)
        if kind == HINTED:
            self.hinted.append((hinted, within))
            hinted = len(self.hinted) - 1
        within = within or name in ("article", "main")
        self.stack.append((name, within, around or kind == SURELY, heading or name in _HEADINGS, hinted))
        self.depths[name] += 1

    def _close_open(self, name: str) -> None:
        """End an element that the start of ``name`` ends: p by any, li by li, cells by cells."""
        last = self.stack[-1][0]
        cells = ("td", "th")
        if last == "head":  # anything to be shown ends an open head
            self._drop(1)
            return
        if last == "p" or last == name or name in cells and last in cells or name == "tr" and last in cells:
            self._drop(1)
            if name == "tr" and self.stack[-1][0] == "tr":
                self._drop(1)

    def _drop(self, n: int) -> None:
        """Take the innermost elements off the stack."""
        self.depths.subtract(e[0] for e in self.stack[-n:])
        del self.stack[-n:]

    def unclosed(self, name: str, page: str, at: int) -> int:
        """Where an element of ``RAW`` without its end tag ends, whose content begins at ``at``."""
        if name in TO_THE_END:
            return len(page)
        for m in _MARKUP.finditer(page, at):
            tag = (m["name"] or "").lower()
            if tag in BLOCK or tag in TO_THE_END or m["end"] and tag == "a" and self.link is not None:
                return m.start()
        return len(page)

    def close(self, name: str) -> None:
        if name == "a":
            self.link = None
        if name not in BLOCK:
            return
        self.close_block()
        if self.depths[name] > 0:  # an end tag that opens nothing is not looked for
            n = 1
            while self.stack[-n][0] != name:
                n += 1
            self._drop(n)
        if self.link is not None and len(self.stack) < self.link:
            self.link = None


def page_blocks(page: str | None) -> tuple[list[str], np.ndarray]:
    """The texts of a page's blocks in order, and a row of ``FEATURES`` for each."""
    page = page or ""
    found, at = _Page(), 0
    endless: set[str] = set()  # names without a further end tag
    while at < len(page):
        m = _MARKUP.search(page, at)
        if m is None:
            found.text(page[at:])
            break
        found.text(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            if m[0].startswith("<![CDATA["):
                found.text(m[0][9:].removesuffix("]]>"))
            continue
        name = m["name"].lower()
        if m["end"]:
            found.close(name)
        elif name in RAW:
            if not (m["attributes"] or "").rstrip().endswith("/"):
                end = None
                if name not in endless:
                    end = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                if end is None:
                    endless.add(name)
                at = end.end() if end else found.unclosed(name, page, at)
        else:
            found.open(name, m["attributes"] or m["broken"] or "")
    found.close_block()
    return found.texts, _features(found.rows, found.hinted)


def _features(rows: list[list[float]], elements: list[tuple[int, bool]]) -> np.ndarray:
    """``FEATURES`` of rows and hinted elements as ``_graded`` takes them."""
    if not rows:
        return np.zeros((0, len(FEATURES)))
    table = np.array(rows, float)
    words, links, within = table[:, 0], table[:, 1], table[:, 2].astype(bool)
    outside = ~within & within.any()
    before = np.concatenate([[0], words[:-1]]), np.concatenate([[0], links[:-1]])
    after = np.concatenate([words[1:], [0]]), np.concatenate([links[1:], [0]])
    return np.stack(
        [words, links, *before, *after, within, outside, _graded(rows, elements), table[:, 4]], axis=1
    )


class DecisionTree:
    """A binary tree of best Gini splits, flattened into node arrays."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 8):
        self._nodes: list[tuple] = []
        self.depth = depth
        self._grow(rows, labels.astype(float), depth)
        columns = zip(*self._nodes, strict=True)
        self.feature, self.threshold, self.left, self.right, self.value = map(np.array, columns)

    def _grow(self, rows: np.ndarray, labels: np.ndarray, depth: int) -> int:
        me = len(self._nodes)
        share = labels.mean() if len(labels) else 0.0
        self._nodes.append((0, np.inf, me, me, share))
        best, split = share * (1 - share) * len(labels) - 1e-9, None
        if depth and 0 < share < 1:
            for f in range(rows.shape[1]):
                order = np.argsort(rows[:, f], kind="stable")
                x, y = rows[order, f], labels[order]
                n = np.arange(1, len(y))
                up = np.cumsum(y)
                p, q = up[:-1] / n, (up[-1] - up[:-1]) / (len(y) - n)
                cost = np.where(x[1:] > x[:-1], p * (1 - p) * n + q * (1 - q) * (len(y) - n), np.inf)
                k = int(cost.argmin()) if len(cost) else 0
                if len(cost) and cost[k] < best:
                    best, split = cost[k], (f, (x[k] + x[k + 1]) / 2)
        if split:
            low = rows[:, split[0]] <= split[1]
            left = self._grow(rows[low], labels[low], depth - 1)
            right = self._grow(rows[~low], labels[~low], depth - 1)
            self._nodes[me] = (*split, left, right, share)
        return me

    def main(self, rows: np.ndarray) -> np.ndarray:
        """Whether each row of features is main text."""
        at = np.zeros(len(rows), np.int64)
        line = np.arange(len(rows))
        for _ in range(self.depth):
            low = rows[line, self.feature[at]] <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        return self.value[at] >= 0.5


def labelled_rows(table: str = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of a labelled table."""
    rows, labels = [], []
    for page in table.strip().split("\n\n"):
        blocks, hinted, known = [], [], {}
        for line in page.splitlines():
            label, path, words, linked = line.split()
            within, around, heading, last = False, False, False, -1
            parts = path.split("/")
            for k, element in enumerate(parts):
                name, *named = re.split("[.#]", element)
                kind = _surrounds(name, {"class": " ".join(named)}, within)
                around |= kind == SURELY
                if kind == HINTED:  # equal paths of a page are one element
                    at = "/".join(parts[: k + 1])
                    if at not in known:
                        known[at] = len(hinted)
                        hinted.append((last, within))
                    last = known[at]
                within |= name in ("article", "main")
                heading |= name in _HEADINGS
            blocks.append([int(words), int(linked) / int(words), within, around, heading, last])
            labels.append(int(label))
        rows.append(_features(blocks, hinted))
    return np.concatenate(rows), np.array(labels)


@lru_cache(maxsize=1)
def trained_tree() -> DecisionTree:
    return DecisionTree(*labelled_rows())


def main_texts(pages: list[str | None], tree: DecisionTree) -> list[str]:
    """The main text of each page: its blocks joined by line feeds."""
    texts, rows = zip(*map(page_blocks, pages), strict=True) if pages else ((), ())
    main = tree.main(np.concatenate(rows)) if pages else []
    out, at = [], 0
    for blocks in texts:
        out.append("\n".join(b for b, m in zip(blocks, main[at:], strict=False) if m))
        at += len(blocks)
    return out


def main_text(
    pages: DataFrame,
    tree: DecisionTree | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """(id, url, text, n_chars) per row of ``pages``.

    A missing or empty page, or one without main text, has an empty text. Every row yields one
    row, repeated ones too; missing ids and urls stay missing. Other columns are never read.
    """
    ship(pages.sparkSession)
    tree = tree or trained_tree()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x for _, run in slices(batch, 2) for x in main_texts(run, tree)]
            sizes = pa.array(list(map(len, texts)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes],
                [id_column, url_column, "text", "n_chars"],
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_column, url_column)]
    schema = f"`{id_column}` {kinds[0]}, `{url_column}` {kinds[1]}, text string, n_chars bigint"
    return pages.select(id_column, url_column, html_column).mapInArrow(extracted, schema)
