"""Main-text extraction from raw HTML by two passes over text blocks.

First pass: each block is decided from its own features. Blocks in page furniture (navigation, header, footer,
aside, form, or an element whose class, id or role names an advert, notice, sidebar or comment list) and blocks
made mostly of link text (inside an article only where they are list items or cells) are boilerplate; long blocks with
many stop words and few links are content; the rest stay undecided. A mark is only a name, so it does not count where the
page speaks against it: on an element around the article, if all articles stand in marked elements, and, on a page
without articles, on an element that holds most of the page's text. Words after has, with or no are no marks. Second pass: an undecided block takes the label of its nearest decided neighbours within the same
article, or within the page body where it stands in no article; between two different labels the nearer wins, and
a tie is content inside an article. Inside an article or main element nothing else is a reason to drop a block, so
junk or one-word paragraphs of an article stay; an article without any decided block is kept whole.

Defined results: a null or empty page gives an empty text; markup that is cut off anywhere is read as far as it goes.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "aber als am an auch auf aus bei das dass dem den der des die ein eine einer er es für hat ich im in ist mit nach nicht oder sich sie sind und von war werden wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qui que sa se ses son sont sur un une vous "
    "al como con de del el ella en era es esta este fue ha la las lo los más me mi no o para pero por que se sin son su sus un una y ya".split()
)
#: Elements whose text is never shown or never prose.
SILENT = frozenset("script style noscript template svg math head title iframe object canvas select option optgroup datalist textarea button audio video map".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: Elements that are page furniture as a whole. A form counts as a mark, as it may hold the whole page.
FURNITURE = frozenset("nav footer aside dialog menu".split())
#: What a head may hold; anything else ends a head whose end tag is left out.
HEAD_ONLY = frozenset("html head title base link meta style script noscript template".split())
ARTICLE = frozenset("article main".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark furniture.
MARKS = frozenset("ad ads advert adverts advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer header login menu modal nav navbar navigation newsletter notice popup promo promoted promotion reader recommended related replies respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split())
#: Of these, the ones that mark furniture inside an article too; the others name its own parts there (a header, a teaser).
INNER = MARKS - frozenset("banner disclaimer header login menu notice reader search skip teaser toolbar".split())
#: Whole names of furniture inside an article.
WHOLE = MARKS - frozenset(["header", "teaser"])
#: Elements that hold an article's own words, whose names come from these words.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORDING = HEADINGS | {"p"}
#: An element that one of these closes when it opens, as browsers do.
CLOSES = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}

LISTED = frozenset("li dt dd".split())

LONG_CHARS, STOP_SHARE, LINK_SHARE = 70, 0.25, 0.4
#: Marked elements around a block that are told apart; those further in belong to the last of them.
DEEP = 64

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"']++)))?")
_INVISIBLE = re.compile(r"display\s*:\s*none")
_CONTRAST = re.compile(r"^(?:has|with|no|without)[-_].*")
_WORD = re.compile(r"[^\W\d_]+")
_MARK_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A run of text between block boundaries."""

    text: str
    link_chars: int
    furniture: bool
    article: int
    listed: bool = False
    #: Numbers of the marked elements around the block, and how many of them are around its article.
    marks: tuple[int, ...] = ()
    around: int = 0


def _names_furniture(token: str, within: bool) -> bool:
    """Whether a class, id or role names furniture, by any of its parts; within an article by some parts, or as a whole."""
    parts = _MARK_WORD.findall(_CONTRAST.sub("", token))
    return not INNER.isdisjoint(parts) or token in WHOLE if within else not MARKS.isdisjoint(parts)


def _marked(attrs: str, within: bool, heading: bool) -> tuple[bool, bool]:
    """Whether an element is hidden, and whether its names mark furniture. A heading's id is made from its words and marks nothing."""
    hidden = marked = False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _INVISIBLE.search(value):
            hidden = True
        elif name in ("class", "id", "role"):
            marked = marked or not (heading and name == "id") and any(_names_furniture(token, within) for token in value.split())
    return hidden, marked


class _Reader:
    """Open elements and the text since the last block boundary. Every step is constant or paid for by what it closes."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack: list[tuple[str, bool, bool, int, tuple[int, ...], int]] = []  # name, silent, furniture, article, marks, around
        self.places: dict[str, list[int]] = {}  # where elements of a name are open
        self.open_blocks: list[int] = []
        self.parts: list[str] = []
        self.linked = self.links = self.articles = self.marked = 0
        self.state: tuple[bool, bool, int, tuple[int, ...], int] = (False, False, 0, (), 0)

    def flush(self) -> None:
        """Ends a block."""
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, furniture, article, marks, around = self.state
                listed = bool(self.open_blocks) and self.stack[self.open_blocks[-1]][0] in LISTED
                self.out.append(Block(text, self.linked, furniture, article, listed, marks, around))
            self.parts.clear()
        self.linked = 0

    def add(self, raw: str) -> None:
        """Takes text in. Text ends a head whose end tag is left out."""
        if raw and self.stack and self.stack[-1][0] == "head" and not raw.isspace():
            self.leave(len(self.stack) - 1)
        if raw and not self.state[0]:
            text = _html.unescape(raw)
            self.parts.append(text)
            if self.links:
                self.linked += len("".join(text.split()))

    def leave(self, depth: int) -> None:
        """Closes all elements from a depth on."""
        if self.open_blocks and self.open_blocks[-1] >= depth:
            self.flush()
        for name, *_ in reversed(self.stack[depth:]):
            self.places[name].pop()
            self.links -= name == "a"
        while self.open_blocks and self.open_blocks[-1] >= depth:
            self.open_blocks.pop()
        del self.stack[depth:]
        self.state = self.stack[-1][1:] if self.stack else (False, False, 0, (), 0)

    def end(self, name: str) -> None:
        """An end tag; one of an inline element doesn't reach beyond the innermost open block."""
        at = self.places.get(name)
        if at and (name in BLOCK or not self.open_blocks or at[-1] > self.open_blocks[-1]):
            self.leave(at[-1])
        elif name in BLOCK:
            self.flush()

    def start(self, name: str, attrs: str) -> None:
        """A start tag."""
        if self.stack and self.stack[-1][0] == "head" and name not in HEAD_ONLY:
            self.leave(len(self.stack) - 1)
        if name in BLOCK:
            self.flush()
            if self.open_blocks and name in CLOSES["p"] and self.stack[self.open_blocks[-1]][0] == "p":
                self.leave(self.open_blocks[-1])
            if self.open_blocks:
                last = self.stack[self.open_blocks[-1]][0]
                if last != "p" and name in CLOSES.get(last, ()):
                    self.leave(self.open_blocks[-1])
        if name in VOID or attrs.endswith("/") and name in SILENT:
            return
        silent, furniture, article, marks, around = self.state
        if name in ARTICLE and not article:
            self.articles += 1
            article, around = self.articles, len(marks)
        if name in FURNITURE or name == "header" and not article:
            furniture = True
        elif (attrs or name == "form") and name not in ("html", "body"):
            hidden, marked = _marked(attrs, article > 0, name in HEADINGS)
            furniture = furniture or hidden
            marked = marked and not (article and name in WORDING)
            if (marked or name == "form") and name not in ARTICLE:
                self.marked += 1
                marks = (*marks, self.marked) if len(marks) < DEEP else marks
        if name in BLOCK:
            self.open_blocks.append(len(self.stack))
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, silent or name in SILENT, furniture, article, marks, around))
        self.state = self.stack[-1][1:]
        self.links += name == "a"


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. article: 0 outside any article, else the number of the outermost one."""
    reader = _Reader()
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            reader.add(page[at:])
            break
        reader.add(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            reader.add(m["cdata"])
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            reader.end(name)
        elif name == "br":
            reader.add(" ")
        else:
            if name in RAW:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else n
                if name in BLOCK or name not in VOID:
                    continue
            reader.start(name, m["attrs"] if m["name"] else m["attrs2"])
    reader.flush()
    return _weighed(reader.out)


def _weighed(found: list[Block]) -> list[Block]:
    """Applies the marks that count as furniture."""
    if not any(b.marks for b in found):
        return found
    ignored: set[int] = set()
    inside = [b for b in found if b.article and not b.furniture]
    if inside:
        if not any(b.around == 0 for b in inside):
            ignored = {k for b in inside for k in b.marks[: b.around]}
    else:
        sizes: dict[int, int] = {}
        seen = [b for b in found if not b.furniture]
        for b in seen:
            for k in b.marks:
                sizes[k] = sizes.get(k, 0) + len(b.text)
        total = sum(len(b.text) for b in seen)
        ignored = {k for k, size in sizes.items() if 2 * size > total}
    for b in found:
        b.furniture = b.furniture or any(k not in ignored for k in b.marks)
    return found


def _long(text: str) -> bool:
    """Whether a block is long prose; letters of scripts that write words without spaces count threefold."""
    return len(text) + 2 * sum(c >= "\u2e80" for c in text) >= LONG_CHARS


def decide(found: list[Block]) -> list[bool]:
    """The two passes: which blocks are content."""
    labels: list[bool | None] = []
    for b in found:
        chars = max(1, len(b.text.replace(" ", "")))
        if b.furniture or b.link_chars > LINK_SHARE * chars and not (b.article and (not b.listed or len(b.text) >= 3 * LONG_CHARS)):
            labels.append(False)
            continue
        words = [w.lower() for w in _WORD.findall(b.text)]
        stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        labels.append(True if len(b.text) >= LONG_CHARS and stop >= STOP_SHARE else None)
    no_article = not any(b.article for b in found)
    if no_article and True not in labels:
        # a language without listed stop words: length and link density decide alone
        labels = [True if label is None and _long(b.text) else label for b, label in zip(found, labels, strict=True)]
    ahead: list[tuple[int, bool] | None] = [None] * len(found)
    last: dict[int, tuple[int, bool]] = {}
    for i in range(len(found) - 1, -1, -1):
        ahead[i] = last.get(found[i].article)
        if labels[i] is not None and not (found[i].furniture and found[i].article):
            last[found[i].article] = (i, labels[i])
    out: list[bool] = []
    last = {}
    for i, b in enumerate(found):
        label = labels[i]
        if label is None:
            before, after = last.get(b.article), ahead[i]
            if b.article and not (before and after and before[1] == after[1] is False):
                label = True
            elif before and after and before[1] != after[1]:
                label = before[1] if i - before[0] < after[0] - i else after[1] if i - before[0] > after[0] - i else False
            else:
                near = before or after
                label = near[1] if near else no_article
        if labels[i] is not None and not (b.furniture and b.article):
            last[b.article] = (i, label)
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """The page's main text, its blocks joined by one newline; empty if there is none."""
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, decide(found), strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: the columns in keep, text, n_chars. No shuffle; a page is parsed within its own task."""
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), "text string", "n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, html_col).mapInArrow(run, schema)
