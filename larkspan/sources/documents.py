"""Readers of single documents: HTML, CSV, EPUB, DOCX, PPTX, XLSX, manifests, unit ranges.

Each reader maps bytes to ordered units (number, name, text); ``extract`` runs
them over a ``binaryFile`` table, one file a row, failures as a reason.
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import tomllib
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from larkspan.session import ship
from larkspan.sources.corpus import decode_bytes, group_parts

MAX_ROWS = 100_000
_SKIP = {"script", "style", "svg", "head", "noscript", "template"}
_BLOCK = {"p", "div", "section", "article", "header", "footer", "main", "ul", "ol", "table", "blockquote", "pre", "br", "hr", "form", "nav", "aside", "body"}


class _Blocks(HTMLParser):
    """Collects text blocks: the title and headings with #, list items with -, table rows with |."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.text: list[str] = []
        self.lead, self.skip, self.cells, self.title = "", 0, None, False

    def flush(self) -> None:
        t = re.sub(r"\s+", " ", "".join(self.text)).strip()
        if t:
            self.out.append(self.lead + t)
        self.text, self.lead = [], ""

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.title = True
        if tag in _SKIP:
            self.skip += 1
        elif self.skip:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.lead = "#" * int(tag[1]) + " "
        elif tag == "li":
            self.flush()
            self.lead = "- "
        elif tag == "tr":
            self.flush()
            self.cells = []
        elif tag in ("td", "th"):
            self.text = []
        elif tag in _BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag == "title":
            self.title = False
            t = re.sub(r"\s+", " ", "".join(self.text)).strip()
            self.text = []
            if t:
                self.out.append("# " + t)
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append(re.sub(r"\s+", " ", "".join(self.text)).strip())
            self.text = []
        elif tag == "tr" and self.cells is not None:
            if any(self.cells):
                self.out.append(" | ".join(self.cells))
            self.cells, self.text = None, []
        elif tag in _BLOCK or tag == "li" or re.fullmatch("h[1-6]", tag):
            self.flush()

    def handle_data(self, data):
        if not self.skip or self.title:
            self.text.append(data)


def html_blocks(data: bytes | str) -> list[str]:
    text = data if isinstance(data, str) else (decode_bytes(data, "latin-1")[0] or "")
    p = _Blocks()
    p.feed(text)
    p.close()
    p.flush()
    return p.out


def csv_rows(data: bytes) -> Iterator[str]:
    """Rows with their cells joined by tabs, empty ones left out; the delimiter is sniffed in the first 4 KiB."""
    text = decode_bytes(data, "latin-1")[0] or ""
    try:
        dialect = csv.Sniffer().sniff(text[:4096], ",;\t|")
    except csv.Error:
        dialect = csv.excel
    for n, row in enumerate(csv.reader(io.StringIO(text), dialect)):
        if n >= MAX_ROWS:
            return
        if any(c.strip() for c in row):
            yield "\t".join(c.strip() for c in row)


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _xml(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name))


def docx_blocks(data: bytes) -> Iterator[str]:
    """Paragraphs, headings with # by level, table rows with |."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in _xml(z, "word/document.xml") if _tag(e) == "body")

    def text(e):
        return "".join(t.text or "" if _tag(t) == "t" else "\t" if _tag(t) == "tab" else "" for t in e.iter())

    for e in body:
        if _tag(e) == "p":
            style = next((v for s in e.iter() if _tag(s) == "pStyle" for k, v in s.attrib.items() if k.endswith("val")), "")
            level = re.fullmatch(r"(?i)heading ?(\d)", style)
            t = text(e).strip()
            if t:
                yield ("#" * int(level[1]) + " " if level else "") + t
        elif _tag(e) == "tbl":
            for row in (r for r in e.iter() if _tag(r) == "tr"):
                yield " | ".join(text(c).strip() for c in row if _tag(c) == "tc")


def pptx_slides(data: bytes) -> Iterator[tuple[str, str]]:
    """(name, text) of each slide in order, its notes after it."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for n in names:
            k = int(re.search(r"\d+", n)[0])

            def lines(name):
                return ["".join(t.text or "" for t in p.iter() if _tag(t) == "t") for p in _xml(z, name).iter() if _tag(p) == "p"]

            text = [x for x in lines(n) if x.strip()]
            notes = f"ppt/notesSlides/notesSlide{k}.xml"
            if notes in z.namelist():
                text += ["Notes: " + x for x in lines(notes) if x.strip()]
            yield f"slide {k}", "\n".join(text)


def xlsx_sheets(data: bytes) -> Iterator[tuple[str, str]]:
    """(sheet, rows with tabs) with shared strings and cached values; at most MAX_ROWS rows a sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in _xml(z, "xl/sharedStrings.xml") if _tag(si) == "si"]
        sheets = [e.attrib.get("name", "") for e in _xml(z, "xl/workbook.xml").iter() if _tag(e) == "sheet"]
        for k, name in enumerate(sheets, 1):
            rows = []
            for row in (r for r in _xml(z, f"xl/worksheets/sheet{k}.xml").iter() if _tag(r) == "row"):
                cells = []
                for c in (c for c in row if _tag(c) == "c"):
                    v = next((x.text or "" for x in c.iter() if _tag(x) in ("v", "t")), "")
                    cells.append(shared[int(v)] if c.attrib.get("t") == "s" and v else v)
                if any(cells):
                    rows.append("\t".join(cells))
                if len(rows) >= MAX_ROWS:
                    break
            yield name, "\n".join(rows)


def epub_chapters(data: bytes) -> Iterator[tuple[str, str]]:
    """(name, text) of the spine's documents in reading order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        opf = next(e.attrib["full-path"] for e in _xml(z, "META-INF/container.xml").iter() if _tag(e) == "rootfile")
        root = _xml(z, opf)
        items = {e.attrib["id"]: e.attrib["href"] for e in root.iter() if _tag(e) == "item"}
        for ref in (e.attrib["idref"] for e in root.iter() if _tag(e) == "itemref"):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), items[ref]))
            yield items[ref], "\n".join(html_blocks(z.read(name)))


def pdf_pages(data: bytes, most: int = 300) -> Iterator[tuple[str, str]]:
    """Pages by the optional reader ``pypdf``; without it the file is refused with a reason."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no reader for PDF is installed") from e
    for k, page in enumerate(PdfReader(io.BytesIO(data)).pages[:most], 1):
        yield f"page {k}", page.extract_text() or ""


def units(path: str, data: bytes) -> list[tuple[int, str, str]]:
    """(number, name, text) of a document by its extension; ValueError says why it is refused."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in ("html", "htm"):
        parts = [("part", "\n".join(p)) for p in group_parts(html_blocks(data))]
    elif ext == "csv":
        parts = [("part", "\n".join(p)) for p in group_parts(list(csv_rows(data)))]
    elif ext == "docx":
        parts = [("part", "\n".join(p)) for p in group_parts(list(docx_blocks(data)))]
    elif ext in ("pptx", "xlsx", "epub", "pdf"):
        parts = list({"pptx": pptx_slides, "xlsx": xlsx_sheets, "epub": epub_chapters, "pdf": pdf_pages}[ext](data))
    else:
        text, _ = decode_bytes(data)
        if text is None:
            raise ValueError("not text in a known encoding")
        parts = [("text", text)]
    return [(k, n, t) for k, (n, t) in enumerate(parts, 1)]


def location_kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    return (F.when(ext == "pdf", "page").when(ext == "pptx", "slide").when(ext == "xlsx", "sheet").when(ext == "epub", "chapter")
            .when(ext.isin("docx", "html", "htm", "csv"), "part").otherwise("source_line"))


def extract(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, number, name, text, reason): the units of every file; a file that cannot be read is one row with the reason."""
    ship(files.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = []
            for p, c in zip(pdf[path], pdf[content], strict=True):
                try:
                    rows += [(p, *u, None) for u in units(p, bytes(c))]
                except (ValueError, KeyError, StopIteration, RuntimeError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((p, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "number", "name", "text", "reason"]).astype({"number": "Int32"})

    return files.select(path, content).mapInPandas(run, "path string, number int, name string, text string, reason string")


def parse_ranges(spec: str, count: int, names: list[str] = ()) -> list[int]:
    """Unit numbers of a spec such as ``3``, ``3-5``, ``7-``, ``-4``, lists of them and unit names; distinct, in order."""
    out: list[int] = []
    for part in (p.strip() for p in spec.split(",")):
        if part in names:
            out.append(list(names).index(part) + 1)
        elif m := re.fullmatch(r"(\d*)\s*-\s*(\d*)", part):
            if not part.strip("- "):
                raise ValueError(f"bad range: {part!r}")
            out += range(int(m[1] or 1), min(int(m[2] or count), count) + 1)
        elif part.isdigit() and 1 <= int(part) <= count:
            out.append(int(part))
        else:
            raise ValueError(f"bad range: {part!r}")
    return list(dict.fromkeys(out))


def dependencies(path: str, text: str) -> list[tuple[str, str, str]]:
    """(ecosystem, name, specifier) of a dependency manifest; nothing for other files."""
    name = path.rsplit("/", 1)[-1]
    if name == "package.json":
        doc = json.loads(text or "{}")
        return [("npm", k, str(v)) for key in ("dependencies", "devDependencies", "optionalDependencies") for k, v in (doc.get(key) or {}).items()]
    if re.fullmatch(r"requirements[\w.-]*\.txt", name):
        rows = (re.match(r"\s*([A-Za-z0-9._-]+)(?:\[[^]]*\])?\s*([^;#]*)", x) for x in text.splitlines() if not x.lstrip().startswith(("#", "-")))
        return [("pypi", m[1].lower(), m[2].strip()) for m in rows if m]
    if name == "go.mod":
        return [("go", m[1], m[2]) for m in re.finditer(r"^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+(v[\w.+-]+)", text, re.M)]
    if name == "pyproject.toml":
        specs = tomllib.loads(text).get("project", {}).get("dependencies", [])
        return [("pypi", m[1].lower(), m[2].strip()) for s in specs if (m := re.match(r"([A-Za-z0-9._-]+)(?:\[[^]]*\])?\s*([^;]*)", s))]
    if name == "Cargo.toml":
        doc = tomllib.loads(text)
        return [("cargo", k, v if isinstance(v, str) else str(v.get("version", ""))) for key in ("dependencies", "dev-dependencies") for k, v in doc.get(key, {}).items()]
    if name == "pom.xml":
        root = ElementTree.fromstring(text)
        deps = (d for d in root.iter() if _tag(d) == "dependency")
        fields = ({_tag(c): (c.text or "").strip() for c in d} for d in deps)
        return [("maven", f"{f.get('groupId', '')}:{f.get('artifactId', '')}", f.get("version", "")) for f in fields]
    return []


def reduced_version(ecosystem: Column, specifier: Column) -> Column:
    """The version that a specifier pins or starts at; null where it names none."""
    v = F.regexp_extract(specifier, "(\\d+(?:\\.\\d+)*(?:[-+][\\w.]+)?)", 1)
    return F.when(specifier.rlike("^\\s*(\\*|latest|)\\s*$"), None).when(ecosystem == "go", F.regexp_extract(specifier, "^v([\\w.+-]+)", 1)).otherwise(F.nullif(v, F.lit("")))
