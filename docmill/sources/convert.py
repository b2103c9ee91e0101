"""Text out of files: decoding, HTML to Markdown, and a registry for other formats."""

from __future__ import annotations

import functools
import io
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.text import BLANK, strip

#: Elements whose content isn't part of a page's text (fixed values).
LEFT_OUT = {"script", "style", "noscript", "template", "head", "nav", "footer", "aside", "form", "iframe", "svg"}

#: Elements that can't stand in a head, so that one that is open ends where they begin (fixed values).
_ENDS_HEAD = {"body", "p", "div", "main", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table"}
_BLOCKS = {"p", "div", "section", "article", "main", "header", "ul", "ol", "table", "blockquote", "pre", "figure", "br", "tr", "li", "hr"}


class _Markdown(HTMLParser):
    """``closed`` has the elements that the page closes somewhere."""

    def __init__(self, closed: set[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.closed = closed
        self.out: list[str] = []
        self.skipped: list[str] = []
        self.lists: list[list] = []
        self.cells: list[str] | None = None
        self.rows: list[list[str]] | None = None
        self.links: list[str | None] = []

    def _put(self, text: str) -> None:
        (self.out if self.cells is None else self.cells).append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if "head" in self.skipped and tag in _ENDS_HEAD:
            self.skipped = []
        if tag in LEFT_OUT:
            if tag in self.closed:  # one that is never closed holds nothing but what its own kind may
                self.skipped.append(tag)
            elif tag == "head":
                self.skipped = ["head"]
        if self.skipped:
            return
        if re.fullmatch("h[1-6]", tag):
            self._put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self._put("\n")
        elif tag == "li":
            self.lists = self.lists or [["ul", 0]]
            self.lists[-1][1] += 1
            mark = "- " if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}. "
            self._put("\n" + "  " * (len(self.lists) - 1) + mark)
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cells = []
        elif tag in ("strong", "b"):
            self._put("**")
        elif tag in ("em", "i"):
            self._put("*")
        elif tag == "code":
            self._put("`")
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
            self._put("[")
        elif tag == "br":
            self._put("\n")
        elif tag in _BLOCKS:
            self._put("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skipped:
            del self.skipped[self.skipped.index(tag) :]
        if self.skipped:
            return
        if tag in ("td", "th") and self.cells is not None and self.rows:
            self.rows[-1].append(re.sub(r"\s+", " ", "".join(self.cells)).strip().replace("|", "\\|"))
            self.cells = None
        elif tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if r], None
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                self._put("\n\n" + "\n".join([lines[0], "|" + "---|" * width, *lines[1:]]) + "\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._put("\n")
        elif tag in ("strong", "b"):
            self._put("**")
        elif tag in ("em", "i"):
            self._put("*")
        elif tag == "code":
            self._put("`")
        elif tag == "a" and self.links:
            href = self.links.pop()
            self._put(f"]({href})" if href else "]")
        elif tag in _BLOCKS - {"li", "br", "tr", "hr"} or re.fullmatch("h[1-6]", tag):
            self._put("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self._put(re.sub(r"\s+", " ", data))


def html_to_markdown(html: str | None) -> str | None:
    """The text of a page as Markdown: tables kept, comments, scripts and navigation left out; null where nothing is left."""
    if not html:
        return None
    parser = _Markdown({m.lower() for m in re.findall(r"</\s*([A-Za-z]+)", html)})
    parser.feed(html)
    parser.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(parser.out))
    text = re.sub(r"\n[ \t]+(?![-\d ])", "\n", re.sub(r"\n{3,}", "\n\n", text))
    return text.strip() or None


@F.pandas_udf(T.StringType())
def html_markdown(pages: pd.Series) -> pd.Series:
    """:func:`html_to_markdown` by Arrow batches."""
    return pages.map(html_to_markdown)


def strip_tags(html: Column | str) -> Column:
    """A page's text by column functions alone: comments, scripts and tags out, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head|nav|footer)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(bare, f"{BLANK}+", " "))


def utf8(content: Column | str) -> Column:
    """Bytes as text, strictly: null where they aren't UTF-8."""
    return F.try_validate_utf8((content if isinstance(content, Column) else F.col(content)).cast("string"))


#: Parts of Office documents that hold text, and their elements for a block and a run of text (fixed values).
_OFFICE = {
    ".docx": (r"word/document()\.xml", "p", "t"),
    ".pptx": (r"ppt/slides/slide(\d+)\.xml", "p", "t"),
}


def _named(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def office_text(data: bytes, extension: str) -> str | None:
    """Text of a document or of slides: its paragraphs a line each, table rows as Markdown's, slides in their order."""
    part, block, run = _OFFICE[extension]
    out: list[str] = []

    def text_of(element: ElementTree.Element) -> str:
        return "".join((x.text or "") if _named(x) == run else "\n" if _named(x) == "br" else "" for x in element.iter())

    def walk(element: ElementTree.Element) -> None:
        for child in element:
            name = _named(child)
            if name == "tr":
                cells = [" ".join(text_of(c).split()).replace("|", "\\|") for c in child if _named(c) == "tc"]
                out.append("| " + " | ".join(cells) + " |")
            elif name == block:
                out.append(text_of(child))
            else:
                walk(child)

    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = [(int(m[1] or 0), n) for n in archive.namelist() if (m := re.fullmatch(part, n))]
        for _, name in sorted(names):
            walk(ElementTree.fromstring(archive.read(name)))
    return "\n".join(out).strip() or None


def sheet_text(data: bytes) -> str | None:
    """Text of a workbook: each sheet's rows as a Markdown table."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            items = (x for x in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")) if _named(x) == "si")
            shared = ["".join(t.text or "" for t in item.iter() if _named(t) == "t") for item in items]
        out = []
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for row in (x for x in ElementTree.fromstring(archive.read(name)).iter() if _named(x) == "row"):
                cells = []
                for cell in (c for c in row if _named(c) == "c"):
                    said = "".join(t.text or "" for t in cell.iter() if _named(t) in ("v", "t"))
                    cells.append(shared[int(said)] if cell.get("t") == "s" and said else said)
                out.append("| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |")
            out.append("")
    return "\n".join(out).strip() or None


#: Converters by file extension, from bytes to text; formats that need a library are registered by its user.
_CONVERTERS: dict[str, Callable[[bytes], str | None]] = {
    ".docx": functools.partial(office_text, extension=".docx"),
    ".pptx": functools.partial(office_text, extension=".pptx"),
    ".xlsx": sheet_text,
}


def register(extension: str, converter: Callable[[bytes], str | None]) -> None:
    """Use ``converter`` for files with this extension, such as ``.pdf``."""
    _CONVERTERS[extension.lower()] = converter


def registered() -> dict[str, Callable[[bytes], str | None]]:
    """The converters registered so far."""
    return dict(_CONVERTERS)


def converted(extension: Column, content: Column, converters: dict[str, Callable[[bytes], str | None]]) -> Column:
    """Text of files by their converters; null for formats without one and files that fail."""

    @F.pandas_udf(T.StringType())
    def convert(kind: pd.Series, data: pd.Series) -> pd.Series:
        def one(k: str, d: bytes) -> str | None:
            try:
                return converters[k](bytes(d)) if k in converters and d is not None else None
            except Exception:  # noqa: BLE001 - a broken file is skipped, as an unreadable one is
                return None

        return pd.Series([one(k, d) for k, d in zip(kind, data)], dtype=object)

    return convert(extension, content)
