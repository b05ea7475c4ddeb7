"""Files to blocks: plain text and markdown, HTML. Each takes bytes and yields (page, type, text, x0, y0, x1, y1).

What has no layout gets rectangles by its order on the page, one below the other, so blocks never overlap.
PDF needs a package of its own: any function of this form can be passed to ``elements.extract``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

_row = re.compile(r"^\s*\|.*\|\s*$")
#: HTML tags that begin a block of text, and those whose content is no text (fixed values of HTML).
_BLOCKS = frozenset("p div section article header footer main li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption br hr".split())
_SILENT = frozenset("script style template noscript head".split())


def _placed(pages: Iterator[tuple[int, str, str]]) -> Iterator[tuple[int, str, str, float, float, float, float]]:
    page, y = None, 0
    for number, kind, text in pages:
        page, y = number, y + 1 if number == page else 0
        yield number, kind, text, 0.0, float(y), 1.0, float(y + 1)


def text_blocks(content: bytes) -> Iterator[tuple[int, str, str, float, float, float, float]]:
    """Plain text or markdown: blank lines end blocks, form feeds end pages, runs of lines between bars are tables."""

    def found() -> Iterator[tuple[int, str, str]]:
        for number, page in enumerate(content.decode("utf-8", "replace").replace("\r\n", "\n").split("\f"), 1):
            for part in re.split(r"\n[^\S\n]*\n", page):
                lines: list[str] = []
                table = False
                for line in [*part.strip("\n").split("\n"), None]:
                    is_row = line is not None and bool(_row.match(line))
                    if lines and (line is None or is_row != table):
                        block = "\n".join(lines).strip()
                        if block:
                            yield number, "Table" if table else "NarrativeText", block
                        lines = []
                    if line is not None:
                        lines.append(line)
                        table = is_row

    return _placed(found())


class _Html(HTMLParser):
    """Blocks of text, and tables as markdown; what stands in a table is not repeated as text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[int, str, str]] = []
        self.title, self.text, self.silent, self.tables, self.rows, self.in_title = "", "", 0, 0, [], False

    def _flush(self) -> None:
        block = re.sub(r"\s+", " ", self.text).strip()
        if block:
            self.out.append((1, "NarrativeText", block))
        self.text = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "title":
            self.in_title = True
        if tag in _SILENT:
            self.silent += 1
        elif tag == "table":
            if not self.tables:
                self._flush()
                self.rows = []
            self.tables += 1
        elif self.tables:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                if not self.rows:
                    self.rows.append([])
                self.rows[-1].append("")
        elif tag in _BLOCKS:
            self._flush()

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "table" and self.tables:
            self.tables -= 1
            if not self.tables:
                self._table()
        elif not self.tables and tag in _BLOCKS:
            self._flush()

    def _table(self) -> None:
        rows = [[re.sub(r"\s+", " ", c).strip().replace("|", "\\|") for c in r] for r in self.rows if any(c.strip() for c in r)]
        if rows:
            width = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            self.out.append((1, "Table", "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])))

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif self.silent:
            return
        elif self.tables:
            if self.rows and self.rows[-1]:
                self.rows[-1][-1] += data
        else:
            self.text += data

    def close(self) -> None:
        super().close()
        if self.tables:  # never closed
            self._table()
        self._flush()


def _parsed(content: bytes) -> _Html:
    parser = _Html()
    parser.feed(content.decode("utf-8", "replace"))
    parser.close()
    return parser


def html_blocks(content: bytes) -> Iterator[tuple[int, str, str, float, float, float, float]]:
    """HTML: blocks of text and tables in the order of the file, on one page."""
    return _placed(iter(_parsed(content).out))


def html_title(content: bytes) -> str:
    return re.sub(r"\s+", " ", _parsed(content).title).strip()


def of_file(name: str, content: bytes) -> Iterator[tuple[int, str, str, float, float, float, float]]:
    """Blocks of a file by its ending: HTML, else text."""
    return html_blocks(content) if name.lower().endswith((".html", ".htm")) else text_blocks(content)


def title_of(name: str, content: bytes) -> str:
    """The title a file states itself: HTML's, else the first markdown heading; none: an empty text."""
    if name.lower().endswith((".html", ".htm")):
        return html_title(content)
    m = re.search(r"^#\s+(.+)$", content.decode("utf-8", "replace"), re.M)
    return m[1].strip() if m else ""
