"""What landed bytes are, and their text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sniff_format(content: Column) -> Column:
    """pdf, html, xml or null by the first 512 bytes."""
    head = F.lower(F.ltrim(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    return F.when(head.startswith("%pdf-"), "pdf").when(head.startswith("<!doctype html") | head.startswith("<html"), "html").when(head.startswith("<?xml"), "xml")


def resolve_format(content: Column, content_type: Column, url: Column, hint: Column) -> Column:
    """By the bytes, else the declared type, else the URL's suffix, else the hint."""
    by_type = F.when(F.contains(F.lower(content_type), F.lit("pdf")), "pdf").when(F.contains(F.lower(content_type), F.lit("html")), "html").when(F.contains(F.lower(content_type), F.lit("xml")), "xml")
    path = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    by_url = F.when(path.endswith(".pdf"), "pdf").when(path.rlike(r"\.html?$"), "html").when(path.rlike(r"\.(n?xml)$"), "xml")
    return F.coalesce(sniff_format(content), by_type, by_url, hint)


class _Paragraphs(HTMLParser):
    """Texts of <p> within the first <article>, else <main>, else the page; or else all text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = {"article": 0, "main": 0}
        self.ignored = 0
        self.p: dict[str, list[str]] = {"article": [], "main": [], "page": []}
        self.all: dict[str, list[str]] = {"article": [], "main": [], "page": []}
        self.current: list[str] | None = None

    def scopes(self) -> list[str]:
        return ["page", *(k for k, n in self.open.items() if n)]

    def flush(self) -> None:
        if self.current is not None:
            text = " ".join("".join(self.current).split())
            for scope in self.scopes():
                if text:
                    self.p[scope].append(text)
            self.current = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.ignored += 1
        elif tag == "p":
            self.flush()
            self.current = []
        elif tag in self.open:
            self.open[tag] += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.ignored = max(0, self.ignored - 1)
        elif tag == "p":
            self.flush()
        elif tag in self.open:
            self.flush()
            self.open[tag] = max(0, self.open[tag] - 1)

    def handle_data(self, data):
        if self.ignored:
            return
        if self.current is not None:
            self.current.append(data)
        if data.strip():
            for scope in self.scopes():
                self.all[scope].append(data.strip())


def html_text(html: str | None) -> str | None:
    if not html:
        return None
    parser = _Paragraphs()
    parser.feed(html)
    parser.close()
    parser.flush()
    scope = next((s for s in ("article", "main") if parser.all[s]), "page")
    return "\n\n".join(parser.p[scope]) or "\n".join(parser.all[scope]) or None


class _Within(HTMLParser):
    """Texts of <p> within the first <div> that has the class."""

    def __init__(self, name: str):
        super().__init__(convert_charrefs=True)
        self.name, self.depth, self.done = name, 0, False
        self.found: list[str] = []
        self.current: list[str] | None = None

    def flush(self) -> None:
        if self.current is not None:
            self.found.append("".join(self.current))
        self.current = None

    def handle_starttag(self, tag, attrs):
        if tag == "div" and not self.done:
            self.depth += bool(self.depth or self.name in (dict(attrs).get("class") or "").split())
        elif tag == "p" and self.depth and not self.done:
            self.flush()
            self.current = []

    def handle_endtag(self, tag):
        if tag == "p":
            self.flush()
        elif tag == "div" and self.depth and not self.done:
            self.depth -= 1
            if not self.depth:
                self.flush()
                self.done = True

    def handle_data(self, data):
        if self.current is not None:
            self.current.append(data)


def pmc_html_text(html: str | None) -> str | None:
    """Paragraphs of a PMC page's article body, joined by blank lines."""
    for name in ("article-body", "tsec"):
        parser = _Within(name)
        parser.feed(html or "")
        parser.close()
        parser.flush()
        if parser.depth or parser.done:
            return "\n\n".join(parser.found) or None
    return None


def xml_text(xml: str | None) -> str | None:
    """Paragraphs of <body>; null for articles whose text isn't given out."""
    if not xml or "cannot be obtained" in xml or "restricted" in xml:
        return None
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None
    name = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    body = next((e for e in root.iter() if name(e) == "body"), None)
    if body is None:
        return None
    paragraphs = [" ".join("".join(e.itertext()).split()) for e in body.iter() if name(e) == "p"]
    return "\n\n".join(p for p in paragraphs if p) or None


def pdf_text(content: bytes | None, backend: str = "pypdf") -> str | None:
    """Pages joined by a blank line. The backend is optional; an unknown one is an error."""
    if backend != "pypdf":
        raise ValueError(f"unknown PDF backend: {backend}")
    import io

    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content or b"")).pages]
    return "\n\n".join(p for p in pages if p.strip()) or None


def decoded(content: bytes, content_type: str | None = None) -> str:
    """By the charset that the type declares, else UTF-8; what can't be read is replaced."""
    charset = (content_type or "").partition("charset=")[2].split(";")[0].strip("\"' ") or "utf-8"
    try:
        return content.decode(charset, "replace")
    except LookupError:
        return content.decode("utf-8", "replace")


#: Text by format, from bytes and declared type; further formats and PDF backends are added here.
EXTRACTORS = {
    "pdf": lambda raw, content_type=None: pdf_text(raw),
    "html": lambda raw, content_type=None: html_text(decoded(raw, content_type)),
    "xml": lambda raw, content_type=None: xml_text(decoded(raw, content_type)),
}


def write_files(files: DataFrame, path: str) -> None:
    """Landed bytes of (name, content) as files in a folder that all executors share."""

    def write(rows: Iterator) -> None:
        from pathlib import Path

        for r in rows:
            Path(path, r["name"]).write_bytes(bytes(r["content"]))

    files.select("name", "content").foreachPartition(write)


def extracted_text(content: Column, kind: Column, content_type: Column | None = None) -> Column:
    """Text of bytes of a known format, in an Arrow UDF; bytes of other formats are decoded by
    their declared charset. Null where there is none."""

    def over(data: pd.Series, kinds: pd.Series, types: pd.Series) -> pd.Series:
        def one(raw, kind, declared):
            return None if raw is None else EXTRACTORS.get(kind, decoded)(bytes(raw), declared)

        return pd.Series([one(*x) for x in zip(data, kinds, types, strict=True)], dtype=object)

    none = F.lit(None).cast("string")
    return F.pandas_udf(over, "string")(content, F.coalesce(kind, none), none if content_type is None else content_type)


def text_col(text: Column, extract: Callable[[str | None], str | None]) -> Column:
    """A text extractor over a column, in an Arrow UDF."""

    def over(texts: pd.Series) -> pd.Series:
        return pd.Series([extract(t) for t in texts], dtype=object)

    return F.pandas_udf(over, "string")(text)


def html_text_col(html: Column) -> Column:
    return text_col(html, html_text)


def html_title(html: Column, default: Column) -> Column:
    title = F.trim(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1))
    return F.coalesce(F.nullif(title, F.lit("")), default)
