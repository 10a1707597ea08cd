"""Web pages as documents: text, title, author, counts and a status that says how whole the page was."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MAX_FILE_BYTES

#: Defects that one page lists by name at most; all are counted.
NAMED = 5

# Elements without an end tag, whose content is no markup, that begin a block, and that may stay open.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
HIDDEN = frozenset("script style template noscript head svg".split())
BLOCKS = frozenset("address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OPTIONAL = frozenset("body colgroup dd dt head html li optgroup option p tbody td tfoot th thead tr".split())
#: An open element of the key ends where an element of the value begins.
ENDED_BY = {"p": BLOCKS - {"br"} | {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"}}
MARKS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "##### ", "h6": "###### ", "li": "- "}
AUTHOR_NAMES = ("author", "article:author", "dc.creator")

_name = re.compile(r"[A-Za-z][^\s/>]*")
_attribute = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_space = re.compile(r"\s+")


class _Page:
    """One pass over a page with a stack of open elements. No place is looked at more than a fixed number of times."""

    def __init__(self, source: str):
        self.source = source
        self.found: dict[str, int] = {}
        self.open: list[str] = []
        self.counts: dict[str, int] = {}
        self.hidden = 0
        self.blocks: list[str] = []
        self.now: list[str] = []
        self.mark = ""
        self.title = self.author = self.language = None
        self.defects = 0
        self.named: list[str] = []
        self._read()

    def defect(self, what: str) -> None:
        self.defects += 1
        if len(self.named) < NAMED:
            self.named.append(what)

    def find(self, what: str, start: int) -> int:
        """Where `what` stands next from `start` on; starts only grow, so the last place found serves until it is passed."""
        at = self.found.get(what, 0)
        if 0 <= at < start or what not in self.found:
            at = self.found[what] = self.source.find(what, start)
        return at

    def _flush(self) -> None:
        words = _space.sub(" ", html.unescape("".join(self.now))).strip()
        self.now = []
        if words:
            self.blocks.append(self.mark + words)
            self.mark = ""

    def _break(self, name: str, begins: bool) -> None:
        """A block begins or ends here; cells of a row stay in one block."""
        if name not in ("td", "th"):
            self._flush()
        elif begins and self.now:
            self.now.append(" | ")

    def _end_of_tag(self, start: int) -> int:
        """Where the tag from `start` on ends, past quoted values; -1 if nowhere."""
        at = start
        while True:
            end = self.find(">", at)
            if end < 0:
                return -1
            quoted = None
            for q in ('"', "'"):
                i = self.find(q, at)
                if 0 <= i < end and (quoted is None or i < quoted[0]) and self.source[i - 1 : i].strip() in ("", "="):
                    quoted = i, q
            if quoted is None:
                return end
            closing = self.find(quoted[1], quoted[0] + 1)
            if closing < 0:
                self.defect("unclosed quote")
                return end
            at = closing + 1

    def _pop(self, name: str) -> None:
        self.counts[name] -= 1
        if name in HIDDEN:
            self.hidden -= 1
        if name in BLOCKS:
            self._break(name, False)
            if name in MARKS:
                self.mark = ""

    def _start(self, name: str, attributes: str, closed: bool) -> None:
        while self.open and name in ENDED_BY.get(self.open[-1], ()):
            self._pop(self.open.pop())
        if name in BLOCKS:
            self._break(name, True)
            if name in MARKS:
                self.mark = MARKS[name]
        if name in ("meta", "html"):
            found = {k.lower(): a or b or c for k, a, b, c in _attribute.findall(attributes)}
            if name == "html":
                self.language = found.get("lang") or self.language
            elif (found.get("name") or found.get("property") or "").lower() in AUTHOR_NAMES and self.author is None:
                self.author = html.unescape(found.get("content") or "").strip() or None
        if name not in VOID and not closed:
            self.open.append(name)
            self.counts[name] = self.counts.get(name, 0) + 1
            self.hidden += name in HIDDEN

    def _end(self, name: str) -> None:
        if not self.counts.get(name):
            if name not in VOID and name != "p":
                self.defect(f"</{name}> without a start")
            return
        while True:
            top = self.open.pop()
            self._pop(top)
            if top == name:
                return
            if top not in OPTIONAL:
                self.defect(f"<{top}> not closed")

    def _read(self) -> None:
        source, at, n = self.source, 0, len(self.source)
        while at < n:
            begin = source.find("<", at)
            begin = n if begin < 0 else begin
            if not self.hidden and begin > at:
                self.now.append(source[at:begin])
            at = begin
            if at >= n:
                break
            if source.startswith("<!--", at):
                end = self.find("-->", at + 4)
                if end < 0:
                    self.defect("unclosed comment")
                at = n if end < 0 else end + 3
                continue
            if source[at + 1 : at + 2] in ("!", "?"):
                end = self.find(">", at)
                at = n if end < 0 else end + 1
                continue
            closing = source.startswith("/", at + 1)
            found = _name.match(source, at + 1 + closing)
            if not found:
                if not self.hidden:
                    self.now.append("&lt;")
                at += 1
                continue
            name, end = found.group().lower(), self._end_of_tag(found.end())
            if end < 0:
                self.defect("unclosed tag")
                break
            if closing:
                self._end(name)
            else:
                self._start(name, source[found.end() : end], source[end - 1] == "/")
            at = end + 1
            if not closing and name in RAW:
                at = self._raw(name, at)
        for name in reversed(self.open):
            if name not in OPTIONAL:
                self.defect(f"<{name}> not closed")
        self._flush()

    def _raw(self, name: str, at: int) -> int:
        """Skip to the end tag of an element whose content is no markup; a page's first title is kept."""
        end = at
        while (end := self.find("</", end)) >= 0 and self.source[end + 2 : end + 2 + len(name)].lower() != name:
            end += 2
        text = self.source[at : end if end >= 0 else len(self.source)]
        if name == "title" and self.title is None:
            self.title = _space.sub(" ", html.unescape(text)).strip() or None
        elif name == "textarea" and not self.hidden:
            self.now.append(text)
        return end if end >= 0 else len(self.source)

    @property
    def text(self) -> str:
        return "\n".join(self.blocks)


# name, type: what a page is read into
_PARTS = "text string, title string, author string, language string, n_defects long, defects array<string>"


def read_page(source: str) -> tuple:
    page = _Page(source)
    return page.text, page.title, page.author, page.language, page.defects, page.named


def parsed_pages(pages: DataFrame, html_col: str = "html", path_col: str = "url", most_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """pages with text, title, author, language, word_count, file_size, file_hash, n_defects, status and error_message added or replaced.

    text has a line for each block: headings begin with # marks, list items with a dash, cells are parted by bars; scripts, styles
    and other hidden content are left out. The title is the page's, else the stem of its path. A page is `success`, `partial` if it
    has defects (tags, comments or quotes not closed, ends without a start; its text is what could be read), and `failed`, with empty
    text, if it is null, blank, has more than `most_bytes` bytes or no text. Reading takes one pass, in the task that has the page.
    """

    @F.pandas_udf(_PARTS)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([read_page(x) if x else ("", None, None, None, 0, []) for x in batch], columns=["text", "title", "author", "language", "n_defects", "defects"])

    source = F.col(html_col)
    size = F.coalesce(F.octet_length(source), F.lit(0)).cast("long")
    rows = pages.withColumn("_size", size).withColumn("_page", read(F.when(F.col("_size") <= most_bytes, source)))
    stem = F.regexp_replace(F.substring_index(F.regexp_replace(path_col, r"[?#].*$", ""), "/", -1), r"\.[^.]*$", "")
    part = lambda name: F.col(f"_page.{name}")
    why = F.when(F.col("_size") > most_bytes, "page too large").when(part("text") == "", "no text")
    added: dict[str, Column] = {
        "text": part("text"), "title": F.coalesce(part("title"), F.nullif(stem, F.lit(""))), "author": part("author"), "language": part("language"),
        "word_count": F.regexp_count(part("text"), F.lit(r"\S+")).cast("long"), "file_size": F.col("_size"), "file_hash": F.sha2(source, 256), "n_defects": part("n_defects"),
        "status": F.when(why.isNotNull(), "failed").when(part("n_defects") > 0, "partial").otherwise("success"),
        "error_message": F.coalesce(why, F.nullif(F.array_join(part("defects"), "; "), F.lit(""))),
    }
    return rows.withColumns(added).drop("_size", "_page")
