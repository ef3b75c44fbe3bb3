"""Main text of web pages by line-block distribution.

Markup is stripped, which leaves one line per block.  Lines of parts that are never article (menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts, ...) count as blank, and so do lines that are mostly links outside
a marked article.  The lengths of the lines are summed over sliding windows of WINDOW lines.  Text begins at a surge
point, where the sum rises over the threshold, and goes on to a dive point, where it falls to zero; the lines between are
kept.  An element that a page marks as article (article, main) is evidence: if no stretch outside such elements is
longer than the longest of them, its marks are believed, and every stretch inside them is kept, those outside are not.
Otherwise marked and other stretches are treated alike.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow

#: Lines in a window, and the characters over which a window's sum is a surge where the page marks no article.
WINDOW, SURGE = 3, 86

# Names of elements and words in class or id that say what a part is.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav header footer aside form head menu dialog button select option textarea iframe object svg canvas audio video template noscript search title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar sidebar header footer masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup social share sharing related recommended comment comments commentlist respond replies disqus pagination pager widget toolbar copyright legal disclaimer".split())
COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())
#: An open element of the first kind ends where one of the second begins.
ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "head": {"body"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<name>/?[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
    r"|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")


def _says_never(name: str, rest: str) -> bool:
    """Whether an element with these attributes is no part of an article."""
    if name in NEVER:
        return True
    if not rest or name in ("html", "body"):
        return False
    found = {k.lower(): html.unescape(a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(rest)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return True
    if found.get("role") in ROLES:
        return True
    words = {*_WORD.findall(found.get("class", "")), *_WORD.findall(found.get("id", ""))}
    return bool(words & (COMMENTS if name in ("article", "main") else WORDS))


class _Lines:
    """Collects (text, never, number of the outermost article or 0, characters in links) of each block."""

    def __init__(self):
        self.lines: list[tuple[str, bool, int, int]] = []
        self.parts: list[str] = []
        self.linked = 0

    def end(self, never: bool, inside: int) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, never, inside, self.linked))
        self.parts, self.linked = [], 0


def lines(page: str) -> list[tuple[str, bool, int, int]]:
    out, at = _Lines(), 0
    last = page.rfind(">") + 1  # no tag begins after it, so none is looked for there; only a comment may
    page = page[:last] + page[last:].partition("<!--")[0].replace("<", "&lt;")
    stack: list[tuple[str, bool]] = []  # open elements, and whether they are never article
    blocks: list[int] = []  # places of the open blocks among them
    standing: Counter[str] = Counter()  # how many elements of each name are open
    never = inside = links = article = 0

    def pop() -> None:
        nonlocal never, inside, links
        name, no = stack.pop()
        if blocks and blocks[-1] == len(stack):
            blocks.pop()
        standing[name] -= 1
        never, inside, links = never - no, inside - (name in ("article", "main")), links - (name == "a")

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            text = html.unescape(page[at : token.start()])
            out.parts.append(text)
            out.linked += len(text) * (links > 0)
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if name[0] == "/":
            name = name[1:]
            if name in BLOCKS:
                out.end(never > 0, article * (inside > 0))
            elif name == "br":
                out.parts.append(" ")
            if standing[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in BLOCKS:
            out.end(never > 0, article * (inside > 0))
        elif name == "br":
            out.parts.append(" ")
        while stack and name in ENDS.get(stack[-1][0], ()):
            pop()
        if name in BLOCKS and blocks and stack[blocks[-1]][0] == "p":  # an open paragraph ends, with what is open inside it
            left = blocks[-1]
            while len(stack) > left:
                pop()
        if name not in VOID and not token["rest"].endswith("/"):
            no = _says_never(name, token["rest"])
            if no and name not in BLOCKS:
                out.end(never > 0, article * (inside > 0))
            if name in BLOCKS:
                blocks.append(len(stack))
            stack.append((name, no))
            standing[name] += 1
            article += name in ("article", "main") and not inside
            never, inside, links = never + no, inside + (name in ("article", "main")), links + (name == "a")
    if at < len(page):
        out.parts.append(html.unescape(page[at:]))
    out.end(never > 0, article * (inside > 0))
    return out.lines


def main_text(page: str) -> str:
    """The lines between surge and dive points, with one line feed between."""
    text, length, marks = [], [], []
    was = 0
    for line, never, article, linked in lines(page):
        blank = never or (not article and 2 * linked > len(line))
        if blank or (article > 0) != (was > 0):
            text += [""] * WINDOW  # blank for a whole window: the sum dives to zero
            length += [0] * WINDOW
            marks += [0] * WINDOW
        if not blank:
            text.append(line)
            length.append(len(line))
            marks.append(article)
            was = article
    length += [0] * WINDOW
    sums = [sum(length[i : i + WINDOW]) for i in range(len(text))]
    pieces, i, n = [], 0, len(text)
    while i < n:
        if not sums[i]:
            i += 1
            continue
        dive = next((k for k in range(i, n) if not sums[k]), n)
        at = [k for k in range(i, min(n, dive + WINDOW - 1)) if text[k]]
        pieces.append((max(sums[i:dive]), marks[at[0]] > 0, at))
        i = dive
    sizes: dict[int, int] = {}
    for k in range(n):
        if marks[k]:
            sizes[marks[k]] = sizes.get(marks[k], 0) + length[k]
    outside = max((sum(length[k] for k in at) for _, marked, at in pieces if not marked), default=0)
    if sizes and outside <= max(sizes.values()):
        kept = [at for _, marked, at in pieces if marked]
    else:
        kept = [at for most, _, at in pieces if most > SURGE]
        if not kept and pieces:
            kept = [max(pieces, key=lambda x: x[0])[2]]
    return "\n".join(text[k] for at in kept for k in at)


def extracted(pages: DataFrame, id_cols: list[str], html_col: str = "html") -> DataFrame:
    """(*id_cols, text, n_chars) of every page: the main text of its whole html, its code points.

    Null or empty html, and pages without text, give an empty text.  Repeated rows are treated alike, null ids are
    carried, other columns are not looked at.  An empty table gives no rows.
    """
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in id_cols) + ", text string, n_chars long"

    def run(batches):
        for batch in batches:
            text = [main_text(page.as_py() or "") for page in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*id_cols, "text", "n_chars"])

    return in_arrow(pages.select(*id_cols, html_col), run, schema)
