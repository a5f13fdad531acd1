"""Documents to sections: HTML, Markdown, mail, captions, Office and OpenDocument packages, EPUB, RTF, code and plain text.

Parsers are pure functions of a file's bytes and use the standard library only, so they run in an Arrow function over the
``binaryFile`` source. PDF and the old binary Office formats need libraries that aren't part of this engine: ``PARSERS`` takes one.
"""

from __future__ import annotations

import email
import email.policy
import io
import mailbox
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import caption_runs


class Unsupported(ValueError):
    """No parser reads this format."""


@dataclass
class Section:
    text: str
    heading: str = ""
    page: int | None = None
    locator: str = ""
    kind: str = "text"  # or "table"


@dataclass
class Document:
    sections: list[Section]
    title: str | None = None
    author: str | None = None
    date: str | None = None
    tags: list[str] = field(default_factory=list)


# Elements that hold no content, that head a section, and that end a line.
_SKIPPED = {"script", "style", "noscript", "head", "template", "svg", "nav", "aside", "footer", "form"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCKS = {"address", "article", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "header", "hr", "li", "main", "ol", "p", "pre", "section", "table", "tr", "ul"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def table_text(rows: list[list[str]]) -> str | None:
    """A Markdown table: the first row as header, rows padded or cut to it, bars in cells escaped, blank rows dropped; None under two columns or without data."""
    rows = [[" ".join(c.split()).replace("|", "\\|") for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    if len(rows) < 2 or len(rows[0]) < 2:
        return None
    width = len(rows[0])
    line = lambda r: "| " + " | ".join((r + [""] * width)[:width]) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.sections: list[Section] = []
        self.meta: dict[str, str] = {}
        self.title = ""
        self.lines, self.words = [], []
        self.heading, self.in_heading = "", False
        self.skip: list[str] = []
        self.in_title = False
        self.tables = 0
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def line(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.lines.append(text)

    def close_cell(self) -> None:
        if self.cell is not None and self.rows and self.rows[-1]:
            self.rows[-1][-1] = "".join(self.cell)
        self.cell = None

    def section(self) -> None:
        self.line()
        if self.lines:
            self.sections.append(Section("\n".join(self.lines), self.heading))
        self.lines = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "meta":
            a = dict(attrs)
            name = (a.get("name") or a.get("property") or "").lower()
            if a.get("content"):
                self.meta.setdefault(name, a["content"].strip())
        if tag == "title" and not self.title:
            self.in_title = True
        if tag in _VOID and tag not in _BLOCKS:
            return
        if self.skip or tag in _SKIPPED:
            if tag not in _VOID:
                self.skip.append(tag)
            return
        if tag == "table":
            if not self.tables:
                self.line()
                self.rows = []
            self.tables += 1
        elif tag == "tr" and self.tables:
            self.close_cell()
            self.rows.append([])
        elif tag in ("td", "th") and self.tables:
            self.close_cell()
            if not self.rows:
                self.rows.append([])
            self.cell = []
            self.rows[-1].append("")
        elif tag in _HEADINGS and not self.tables:
            self.section()
            self.in_heading = True
        elif tag in _BLOCKS and self.cell is None:
            self.line()

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if self.skip:
            if tag in self.skip:
                while self.skip and self.skip.pop() != tag:
                    pass
            return
        if tag in ("td", "th", "tr") and self.tables:
            self.close_cell()
        elif tag == "table" and self.tables:
            self.close_cell()
            self.tables -= 1
            if not self.tables:
                text = table_text(self.rows)
                if text:
                    self.section()
                    self.sections.append(Section(text, self.heading, kind="table"))
                else:
                    self.lines += [" ".join(" ".join(r).split()) for r in self.rows if "".join(r).strip()]
        elif tag in _HEADINGS and self.in_heading:
            self.heading, self.words, self.in_heading = " ".join("".join(self.words).split()), [], False
        elif tag in _BLOCKS and self.cell is None:
            self.line()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        if self.skip:
            return
        (self.words if self.cell is None else self.cell).append(data)


def parse_html(data: bytes) -> Document:
    """The body in document order; a heading starts a section, a table is a section of its own, or lines if it has one column or only a header."""
    p = _Html()
    p.feed(data.decode("utf-8", "replace"))
    p.close()
    if p.in_heading:
        p.heading, p.words = " ".join("".join(p.words).split()), []
    p.section()
    if not p.sections:
        raise Unsupported("no text")
    m = p.meta
    tags = [t.strip() for t in m.get("keywords", "").split(",") if t.strip()]
    date = m.get("date") or m.get("article:published_time") or m.get("article:modified_time") or m.get("last-modified")
    return Document(p.sections, " ".join(p.title.split()) or m.get("og:title"), m.get("author"), date, tags)


def parse_markdown(data: bytes) -> Document:
    """Front matter gives title, author, date and tags; a section for each heading outside code fences, pipe tables as sections."""
    text = data.decode("utf-8", "replace").replace("\r\n", "\n")
    meta: dict[str, str] = {}
    if text.startswith("---\n") and (end := text.find("\n---", 4)) >= 0:
        for line in text[4:end].splitlines():
            k, colon, v = line.partition(":")
            if colon:
                meta[k.strip().lower()] = v.strip().strip("\"'")
        text = text[text.find("\n", end + 1) + 1 :]
    sections: list[Section] = []
    heading, held, fence = "", [], False

    def flush() -> None:
        nonlocal held
        body = "\n".join(held).strip()
        if body:
            sections.append(Section(body, heading))
        held = []

    lines, i = text.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
        m = None if fence else re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if m:
            flush()
            heading = m[2]
        elif not fence and "|" in line and i + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)+\|?\s*$", lines[i + 1]):
            flush()
            j = i + 2
            while j < len(lines) and "|" in lines[j]:
                j += 1
            cells = lambda x: [c.strip() for c in x.strip().strip("|").split("|")]
            table = table_text([cells(line), *map(cells, lines[i + 2 : j])])
            if table:
                sections.append(Section(table, heading, kind="table"))
            else:
                held += lines[i:j]
            i = j
            continue
        else:
            held.append(line)
        i += 1
    flush()
    tags = [t.strip().strip("\"'") for t in meta.get("tags", "").strip("[]").split(",") if t.strip()]
    return Document(sections, meta.get("title"), meta.get("author"), meta.get("date"), tags)


def _message(m) -> Section:
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    if body is not None and body.get_content_type() == "text/html":
        text = "\n\n".join(s.text for s in parse_html(text.encode()).sections)
    head = "\n".join(f"{k}: {m[k]}" for k in ("From", "To", "Date", "Subject") if m[k])
    return Section(f"{head}\n\n{text.strip()}", str(m["Subject"] or ""))


def parse_eml(data: bytes) -> Document:
    m = email.message_from_bytes(data, policy=email.policy.default)
    return Document([_message(m)], m["Subject"], m["From"], m["Date"])


def parse_mbox(data: bytes) -> Document:
    """A section for each message."""
    with tempfile.NamedTemporaryFile(suffix=".mbox") as f:
        f.write(data)
        f.flush()
        box = mailbox.mbox(f.name, factory=lambda x: email.message_from_binary_file(x, policy=email.policy.default))
        return Document([_message(m) for m in box])


def _seconds(text: str) -> float:
    total = 0.0
    for part in text.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def cues(text: str) -> Iterator[tuple[float, float, str]]:
    """(start, end, text) of WebVTT or SubRip cues."""
    for block in re.split(r"\n\s*\n", text.replace("\r\n", "\n")):
        lines = block.strip().split("\n")
        at = next((i for i, x in enumerate(lines) if "-->" in x), None)
        if at is not None:
            start, _, end = lines[at].partition("-->")
            yield _seconds(start.strip()), _seconds(end.strip().split()[0]), re.sub(r"<[^>]+>", "", "\n".join(lines[at + 1 :])).strip()


def parse_captions(data: bytes) -> Document:
    return Document([Section(p.content, locator=p.locator) for p in caption_runs(cues(data.decode("utf-8-sig", "replace")))])


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _words(e: ElementTree.Element, text: str = "t") -> str:
    return "".join((x.text or "") if _local(x) == text else "\t" if _local(x) == "tab" else "\n" if _local(x) == "br" else "" for x in e.iter())


def _core(z: zipfile.ZipFile, name: str = "docProps/core.xml") -> dict[str, str]:
    return {_local(e): (e.text or "").strip() for e in _xml(z, name).iter()} if name in z.namelist() else {}


def parse_docx(data: bytes) -> Document:
    """Paragraphs under their headings, tables as sections."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body, core = next(iter(_xml(z, "word/document.xml"))), _core(z)
    sections, heading, held = [], "", []

    def flush() -> None:
        if held:
            sections.append(Section("\n".join(held), heading))
        held.clear()

    for e in body:
        if _local(e) == "p":
            style = next((v for x in e.iter() if _local(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
            text = _words(e).strip()
            if style.lower().startswith(("heading", "title")) and text:
                flush()
                heading = text
            elif text:
                held.append(text)
        elif _local(e) == "tbl":
            rows = [["\n".join(_words(p) for p in c.iter() if _local(p) == "p") for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
            table = table_text(rows)
            if table:
                flush()
                sections.append(Section(table, heading, kind="table"))
            else:
                held += [" ".join(r).strip() for r in rows if "".join(r).strip()]
    flush()
    return Document(sections, core.get("title") or None, core.get("creator") or None, core.get("created") or None)


def parse_pptx(data: bytes) -> Document:
    """A section for each slide, headed by its first line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        sections = []
        for number, n in enumerate(names, 1):
            lines = [t for p in _xml(z, n).iter() if _local(p) == "p" and (t := _words(p).strip())]
            if lines:
                sections.append(Section("\n".join(lines), lines[0], number, f"slide {number}"))
        core = _core(z)
    return Document(sections, core.get("title") or None, core.get("creator") or None)


def parse_odt(data: bytes) -> Document:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root, core = _xml(z, "content.xml"), _core(z, "meta.xml")
    sections, heading, held = [], "", []
    for e in root.iter():
        if _local(e) not in ("h", "p"):
            continue
        text = "".join(e.itertext()).strip()
        if _local(e) == "h" and text:
            if held:
                sections.append(Section("\n".join(held), heading))
            heading, held = text, []
        elif text:
            held.append(text)
    if held:
        sections.append(Section("\n".join(held), heading))
    return Document(sections, core.get("title") or None, core.get("creator") or core.get("initial-creator") or None)


def parse_epub(data: bytes) -> Document:
    """The chapters in spine order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        opf = next(e.attrib["full-path"] for e in _xml(z, "META-INF/container.xml").iter() if _local(e) == "rootfile")
        root, folder = _xml(z, opf), opf.rpartition("/")[0]
        items = {e.attrib["id"]: e.attrib["href"] for e in root.iter() if _local(e) == "item"}
        core = {_local(e): (e.text or "").strip() for e in root.iter() if _local(e) in ("title", "creator", "date")}
        sections = []
        for e in root.iter():
            if _local(e) == "itemref":
                href = items[e.attrib["idref"]]
                try:
                    sections += parse_html(z.read(f"{folder}/{href}" if folder else href)).sections
                except Unsupported:
                    continue
    return Document(sections, core.get("title"), core.get("creator"), core.get("date"))


def parse_rtf(data: bytes) -> Document:
    """The text of an RTF file: groups of fonts, colours, styles, pictures and other destinations are left out."""
    text, out, stack, skip, skipped = data.decode("latin-1"), [], [], 0, False
    for m in re.finditer(r"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", text, re.I):
        word, number, hexa, symbol, brace, char = m.groups()
        if brace == "{":
            stack.append((skip, skipped))
        elif brace == "}":
            skip, skipped = stack.pop() if stack else (0, False)
        elif symbol == "*":
            skipped = True
        elif word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer"):
            skipped = True
        elif skipped:
            continue
        elif word in ("par", "line", "sect", "page"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            skip = 1
        elif hexa:
            if skip:
                skip = 0
            else:
                out.append(bytes([int(hexa, 16)]).decode("cp1252", "replace"))
        elif symbol in ("\\", "{", "}"):
            out.append(symbol)
        elif char:
            if skip:
                skip = 0
            else:
                out.append(char)
    return Document([Section("".join(out).strip())])


def parse_text(data: bytes) -> Document:
    text = data.decode("utf-8-sig", "replace").strip()
    return Document([Section(text)] if text else [])


def _needs_library(data: bytes) -> Document:
    raise Unsupported("this format needs a parser that isn't part of the engine")


CODE = ("py", "rs", "go", "c", "h", "cpp", "hpp", "java", "js", "ts", "tsx", "jsx", "rb", "php", "sh", "sql", "toml", "ini", "cfg", "css", "scala", "kt", "swift", "lua", "r", "pl")
#: Parsers by extension; other formats can be put in.
PARSERS: dict[str, Callable[[bytes], Document]] = {
    **dict.fromkeys(("html", "htm", "xhtml"), parse_html), **dict.fromkeys(("md", "markdown"), parse_markdown), "eml": parse_eml, "mbox": parse_mbox, **dict.fromkeys(("vtt", "srt"), parse_captions),
    "docx": parse_docx, "pptx": parse_pptx, "odt": parse_odt, "epub": parse_epub, "rtf": parse_rtf, **dict.fromkeys(("txt", "log", "text", "yaml", "yml", *CODE), parse_text), **dict.fromkeys(("pdf", "doc", "ppt"), _needs_library),
}

SECTION = "section int, heading string, text string, page int, locator string, kind string, title string, author string, date string, tags array<string>, error string"


def parse(name: str, data: bytes) -> Document:
    suffix = name.rpartition(".")[2].lower()
    if suffix not in PARSERS:
        raise Unsupported(f"no parser for .{suffix}")
    return PARSERS[suffix](data)


def sections(files: DataFrame, key: str, content: str, name: str) -> DataFrame:
    """key and the sections of each file (content binary or string, name with its extension); a file that can't be read has one row with its error."""
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, data, n in pdf.itertuples(index=False, name=None):
                try:
                    doc = parse(n or "", bytes(data) if data is not None else b"")
                    rows += [(k, i, s.heading, s.text, s.page, s.locator, s.kind, doc.title, doc.author, str(doc.date) if doc.date else None, doc.tags, None) for i, s in enumerate(doc.sections)]
                except Exception as e:  # noqa: BLE001  one file's fault is its own row
                    rows.append((k, None, None, None, None, None, None, None, None, None, [], f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=[key, *(c.split()[0] for c in SECTION.split(", "))])
            yield out.astype({"section": "Int32", "page": "Int32"})

    return files.select(key, F.col(content).cast("binary").alias("content"), F.col(name).alias("name")).mapInPandas(run, f"{key} {kind}, {SECTION}")
