"""Main text of web pages, by text-to-tag ratios of their lines.

Parser events of the standard library turn a page into lines, one per block element, each
with its characters, its tags and the region it stands in. The ratios of characters to tags
are smoothed with a Gaussian; a region whose smoothed ratios reach the threshold is
content and keeps all its lines, short ones too. Menus, notices and the like that the markup itself
names do not count as content; a name alone never takes an article away that outweighs all the rest.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Width of the Gaussian in lines, and the share of the ratios' deviation that content must reach.
SIGMA, THRESHOLD = 1.0, 1.0
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("aside button canvas datalist dialog footer form head iframe menu nav noscript object option select style script svg template textarea title".split())
_REGIONS = frozenset("article body div main section td".split())
_MAIN = frozenset(["article", "main"])
_NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr login menu modal nav navbar navigation newsletter notice notices popup promo promotion related replies share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
_BODIES = frozenset("article content entry post story".split())
#: How many times the text of all unnamed content an article of a doubtful name must have.
OUTWEIGHS = 4
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Elements whose end HTML lets one leave out, and the starts that end them.
_ENDS = {"p": _BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}


def _excluded(tag: str, attributes: list[tuple[str, str | None]], in_main: bool) -> bool:
    """Whether the element, its role or its style rule it out, whatever its name."""
    if tag in _NEVER or (tag == "header" and not in_main):
        return True
    for name, value in attributes:
        value = (value or "").strip().lower()
        if name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in "".join(value.split()):
            return True
    return False


def _names(attributes: list[tuple[str, str | None]]) -> set[str]:
    return {w.lower() for name, value in attributes if name in ("class", "id") for w in _WORD.findall(value or "")}


def _side_name(tag: str, names: set[str], in_main: bool) -> bool:
    """Whether class or id name something beside the article."""
    return bool(names & _NAMED) and tag not in ("html", "body") or "header" in names and not in_main and tag == "div"


class Lines(HTMLParser):
    """Lines of a page: text, tags, region, whether the region is a main one, and the doubtful element it stands in (0: none).

    Doubtful is an article whose name says that it is something else.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, bool, int]] = []  # tag, excluded, region, in a main region, doubtful element
        self.open: Counter[str] = Counter()
        self.lines: list[tuple[str, int, int, bool, int]] = []
        self.parts: list[str] = []
        self.held: list[tuple[int, list[str]]] = []
        self.tags, self.regions, self.doubts = 0, 0, 0

    @property
    def top(self) -> tuple[str, bool, int, bool, int]:
        return self.stack[-1] if self.stack else ("", False, 0, False, 0)

    def _push(self, tag: str, *state) -> None:
        self.stack.append((tag, *state))
        self.open[tag] += 1

    def _pop(self) -> None:
        self.open[self.stack.pop()[0]] -= 1

    def _flush(self) -> None:
        _, excluded, region, main, doubt = self.top
        text = " ".join("".join(self.parts).split())
        if text and not excluded:
            self.lines.append((text, self.tags, region, main, doubt))
            self.tags = 0
        elif text:
            self.tags = 0
        self.parts = []

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS:
            self._flush()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        while self.stack and tag in _ENDS.get(self.stack[-1][0], ()):
            self._pop()
        _, excluded, region, main, doubt = self.top
        own, names = _excluded(tag, attributes, main), _names(attributes)
        if not own and _side_name(tag, names, main):
            if tag in _MAIN or tag in _REGIONS and names & _BODIES:
                if not doubt:
                    self.doubts += 1
                    doubt = self.doubts
            else:
                own = True
        if excluded and tag in _MAIN and not own and self.stack[-1][0] in ("nav", "header", "form"):
            excluded = False  # an end tag was left out, or a form wraps the whole page
        if tag in _REGIONS and not main:
            self.regions += 1
            region, main = self.regions, tag in _MAIN
        # Inline words never leave a line: a hidden span is cut out of it.
        if own and not excluded and tag not in _BLOCKS:
            text, self.parts = self.parts, []
            self._push(tag, True, region, main, doubt)
            self.held.append((len(self.stack), text))
            return
        self._push(tag, excluded or own, region, main, doubt)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self._flush()
        self.tags += 1
        if not self.open[tag]:
            return  # nothing to close: the stack is not searched
        while self.stack[-1][0] != tag:
            self._pop()
        self._pop()
        while self.held and self.held[-1][0] > len(self.stack):
            self.parts = self.held.pop()[1]

    def handle_data(self, data: str) -> None:
        if not self.top[1]:
            self.parts.append(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def _content(lines: list[tuple[str, int, int, bool, int]]) -> str:
    """Lines of the regions whose smoothed ratios reach the threshold."""
    if not lines:
        return ""
    smooth = smoothed(np.array([len(text) / max(1, tags) for text, tags, *_ in lines]))
    best: dict[int, float] = {}
    for (_, _, region, *_), value in zip(lines, smooth, strict=True):
        best[region] = max(best.get(region, 0.0), float(value))
    mains = {region for _, _, region, main, _ in lines if main}
    rivals = {r: v for r, v in best.items() if not mains or r in mains}
    threshold = min(THRESHOLD * float(smooth.std()), max(rivals.values()))
    content = {r for r, v in rivals.items() if v >= threshold}
    return " ".join(text for text, _, region, *_ in lines if region in content)


def main_text(html: str) -> str:
    """The content lines of a page, joined by one space.

    They come from what has no doubtful name, unless one doubtful element holds ``OUTWEIGHS`` times as much text or more.
    """
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser._flush()
    plain = _content([line for line in parser.lines if not line[4]])
    weights: Counter[int] = Counter()
    for text, *_, doubt in parser.lines:
        if doubt:
            weights[doubt] += len(text)
    for doubt, weight in weights.most_common(1):
        if weight >= OUTWEIGHS * len(plain):
            return _content([line for line in parser.lines if line[4] == doubt])
    return plain


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars``, its code points; columns of these names are replaced.

    Null and empty html, and pages without content, give an empty text. Every row gives one row.
    """

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        pages = column.to_pylist()
        out: list[str] = []
        for i, j in chunks([len(p or b"") for p in pages]):
            out += [main_text((p or b"").decode("utf-8", "replace")) for p in pages[i:j]]
        return pa.array(out, pa.string())

    found = pages.withColumn("text", text(F.col(html_column).cast("binary")))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
