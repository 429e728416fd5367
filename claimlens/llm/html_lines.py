"""Operator 5. HTML main text by line-block distribution (after Chen Xin's cx-extractor).

Markup is stripped and every block element becomes a line with a size: the length of its text
without anchors. Elements stand apart by empty lines where they divide the page. Sums of sizes
over a sliding window of lines surge where the main text starts and dive where it ends; the
lines between are kept, and so are the lines elsewhere in the blocks that hold them, as an
advert or a list of links within a text doesn't end it. On pages without a surge the highest
windows count as one.

Tags and names only weigh. Text in <article> or <main> weighs NAMED_WEIGHT times as much: it
surges at any length and other text only at as many times the characters, unless a run of other
text outweighs all of it; then no element counts as named. Text of elements whose tag or name
is that of a menu, footer, form, advert, comment or the like weighs a sixteenth, and so
surges only if it is long beyond measure.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from claimlens.llm.shared import pick

WINDOW = 3
#: A window surges at this many characters, or at the page's highest sum if that is less, where no element names the main text; text outside a named element, at NAMED_WEIGHT times as many.
SURGE = 50
NAMED_WEIGHT = 4
#: The part of its size that text apart counts with.
APART_SHARE = 16

# Elements of HTML by what they mean here.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that hold text, but hardly the main one, and elements whose content isn't text of the page at all.
APART = frozenset("aside dialog fieldset footer form menu nav".split())
SILENT = frozenset("applet audio button canvas datalist embed head iframe input label legend map noscript object option script select style svg template textarea title video".split())
NAMED = frozenset("article main".split())
#: The block of lines that are in none which counts.
APART_FROM_ALL = -1
#: Blocks that divide a page; the others are parts of a text.
CONTAINERS = frozenset("article body center div html main section td th".split())
ENDS_P = BLOCKS - {"html", "head", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words of which class, id, role or aria-label names of what isn't main text are made.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs captcha comment comments commentlist complementary consent contentinfo cookie cookies disclaimer disqus "
    "donate feedback footer gdpr hidden login menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion "
    "recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar widget widgets".split()
)
#: Words that may join them in a name ("ad-slot", "comment-list") without making it one of something else ("notice-period").
PLAIN = frozenset("area articles aside bar block body bottom box button buttons card center column dfp google gpt container content dialog fixed footer form global group header icons inner item items left link links list main media message more page panel post posts primary print right secondary section sidebar site slot stories sticky text thread top unit user view wrap wrapper".split())
#: Of these, the ones that tell an advert even on a single paragraph.
ADVERT = frozenset("ad ads advert adverts advertisement advertising cookie cookies newsletter promo promoted promotion sponsor sponsored subscribe subscription".split())
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")


class _Lines(HTMLParser):
    """Collects (text, length without anchors, whether in a named element, innermost block) for each line."""

    def __init__(self, articles: bool = False):
        super().__init__(convert_charrefs=True)
        self.articles = articles  # whether they are wanted whatever they are called
        self.lines: list[tuple[str, int, bool, int]] = []
        self.stack: list[tuple[str, bool, bool, bool, int]] = []  # name, apart, silent, named, block around
        self.blocks: list[tuple[str, int]] = [("html", 0)]  # name, block around; the page itself is 0
        self.block = 0
        self.text: list[str] = []
        self.anchor = 0
        self.apart = self.silent = self.named = self.links = 0

    def line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            size = max(0, len(text) - self.anchor)
            self.lines.append((text, size // APART_SHARE, False, APART_FROM_ALL) if self.apart else (text, size, self.named > 0, self.block))
        self.text, self.anchor = [], 0

    def gap(self) -> None:
        self.line()
        if self.lines and self.lines[-1][0]:
            self.lines += [("", 0, self.named > 0, self.block)] * WINDOW

    def pop(self, upto: int) -> None:
        while len(self.stack) > upto:
            name, apart, silent, named, around = self.stack.pop()
            if name in BLOCKS and not self.silent:
                self.line()
            self.block = around
            self.apart -= apart
            self.silent -= silent
            self.named -= named
            self.links -= name == "a"
            if apart and not self.apart and not self.silent:
                self.gap()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag in BLOCKS and not self.silent:
                self.line()
            elif tag == "br" and not self.silent:
                self.text.append("\n")
            return
        if tag in ENDS_P or tag in ("dt", "dd"):
            self.shut({"p"} if tag not in ("li", "dt", "dd") else {"p", "dt", "dd"} if tag != "li" else {"p", "li"}, BLOCKS)
        elif tag in ("td", "th", "tr"):
            self.shut({"td", "th"} if tag != "tr" else {"td", "th", "tr"}, {"table"})
        unwanted = self.unwanted(tag, attrs)
        if tag in NAMED and (self.apart or self.silent) and not unwanted:  # an unclosed element before the main text doesn't swallow it
            first = next(k for k, s in enumerate(self.stack) if s[1] or s[2])
            if self.stack[first][0] not in ("script", "style"):
                self.pop(first)
        block = tag in BLOCKS
        silent = tag in SILENT or unwanted and not block
        apart = block and not silent and not self.apart and (tag in APART or tag == "header" and not self.named or unwanted)
        if block and not self.silent:
            self.line()
            if apart:
                self.gap()
        self.stack.append((tag, apart, silent, tag in NAMED, self.block))
        if block:
            self.blocks.append((tag, self.block))
            self.block = len(self.blocks) - 1
        self.apart += apart
        self.silent += silent
        self.named += tag in NAMED
        self.links += tag == "a"

    def shut(self, names: set[str], stop: frozenset | set) -> None:
        """End the open elements of these names, up to the nearest other block."""
        upto = len(self.stack)
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in names:
                upto = k
            elif self.stack[k][0] in stop:
                break
        self.pop(upto)

    def unwanted(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("html", "body", "main") or tag == "article" and self.articles:
            return False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
            if name in ("class", "id", "role", "aria-label") and value and tag not in HEADINGS:
                for one in value.split() if name != "aria-label" else [value]:
                    words = {w.lower() for w in _NAME.findall(one) if len(w) > 1}
                    if words & (ADVERT if tag == "p" else UNWANTED) and words <= UNWANTED | PLAIN:
                        return True
        return False

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            return self.handle_starttag("br", [])
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                return self.pop(k)
            if self.stack[k][0] in ("article", "main") and tag in ("b", "i", "em", "strong", "span", "a", "p", "li", "font", "u"):
                return None
        return None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.anchor += len(_SPACE.sub(" ", data))


def _whole(lines: list[tuple[str, int, bool, int]], size: list[int], kept: list[bool], blocks: list[tuple[str, int]]) -> list[bool]:
    """`kept`, and the other lines of the containers whose text is kept: those with a size, and
    between the first and the last of these those without. Of the body only its own text counts,
    not the containers in it."""
    home, named = [0], [0]  # by block: the nearest container (0 for the body) and named element
    for k, (name, around) in enumerate(blocks[1:], 1):
        home.append(0 if name in ("html", "body") else k if name in CONTAINERS else home[around])
        named.append(k if name in NAMED else named[around])
    homes = {home[line[3]] for line, k in zip(lines, kept, strict=True) if k and line[3] != APART_FROM_ALL}
    # Containers that share one are paragraphs of one text.
    shared = Counter(home[blocks[h][1]] for h in homes if h and blocks[h][0] not in NAMED)
    homes |= {h for h, n in shared.items() if n > 1 and h} | {named[h] for h in homes if named[h]}
    near: list[int] = []  # by block: the nearest of the homes, or -1
    for k, (_, around) in enumerate(blocks):
        if k in homes or not home[k]:
            near.append(k if k and k in homes else 0 if 0 in homes else -1)
        else:
            near.append(near[around] or -1)
    own = [-1 if line[3] == APART_FROM_ALL else near[line[3]] for line in lines]
    kept = [k or bool(line[0]) and n > 0 and o >= 0 for k, line, n, o in zip(kept, lines, size, own, strict=True)]
    span: dict[int, tuple[int, int]] = {}
    for k, o in enumerate(own):
        if kept[k] and size[k] and o >= 0:
            span[o] = (span.get(o, (k, k))[0], k)
    return [kept[k] or bool(lines[k][0]) and o in span and span[o][0] < k < span[o][1] for k, o in enumerate(own)]


def _named(lines: list[tuple[str, int, bool, int]]) -> bool:
    """Whether the named elements hold the main text: weighed, no less than the heaviest run outside them."""
    inside = sum(len(line[0]) for line in lines if line[2])
    heaviest = run = empty = 0
    for _, s, n, _ in lines:
        empty = 0 if s and not n else empty + 1
        run = 0 if n or empty >= WINDOW else run + s
        heaviest = max(heaviest, run)
    return 0 < inside and heaviest <= NAMED_WEIGHT * inside


def window_sums(lines: list[tuple[str, int, bool, int]], size: list[int], named: bool) -> list[int]:
    """The sum of the window of lines that starts at each line and doesn't enter or leave a named element."""
    sums = [0] * len(lines)
    for k in range(len(lines)):
        for m in range(k, min(k + WINDOW, len(lines))):
            if named and lines[m][2] != lines[k][2]:
                break
            sums[k] += size[m]
    return sums


def between(lines: list[tuple[str, int, bool, int]], size: list[int], named: bool) -> list[bool]:
    """Which lines lie between a surge and the dive after it."""
    sums = window_sums(lines, size, named)
    floor = min(SURGE * (NAMED_WEIGHT if named else 1), max(sums, default=0)) or 1
    kept, inside = [], False
    for k, (text, _, n, _) in enumerate(lines):
        if named and k and n != lines[k - 1][2]:
            inside = False
        if not inside and sums[k] >= (1 if named and n else floor) and size[k]:
            inside = True  # surge
        elif inside and not sums[k]:
            inside = False  # dive
        kept.append(inside and bool(text))
    return kept


def _text(parser: _Lines, html: str) -> str:
    parser.feed(html)
    parser.close()
    parser.pop(0)
    parser.line()
    lines = parser.lines
    named = _named(lines)
    size = [NAMED_WEIGHT * len(t) if named and n else s for t, s, n, _ in lines]
    kept = _whole(lines, size, between(lines, size, named), parser.blocks)
    return "\n\n".join(line[0] for line, k in zip(lines, kept, strict=True) if k)


def main_text(html: str | None) -> str:
    """The blocks between surge and dive, white space made one space, joined by two newlines.
    Articles whose names are those of comments or teasers count only where nothing else has text."""
    if not html:
        return ""
    return _text(_Lines(), html) or _text(_Lines(articles=True), html)


def html_lines(pages: DataFrame) -> DataFrame:
    """One row per row of (page_id, url, html): page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without main text, have the empty text. Broken markup is
    read as far as it goes: open elements end with their parents or the page. Pages of any
    length are read whole. Ids and urls may be null or repeat. An empty table gives an empty result; further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pick(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
