"""Files and tables of raw content to ordered blocks: text, HTML, office formats, and the quality gate."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.shipping import by_value

by_value(__name__)

BLOCKS = "version_id string, block_order int, block_type string, page int, section_path array<string>, text string, review_reason string"
LEAST_CHARS = 50
TEXT_SUFFIXES, HTML_SUFFIXES = ("txt", "md", "json"), ("html", "htm")
#: Bounds on an office file's parts, so that a small file cannot unpack into an unbounded one.
MOST_UNPACKED = 512 * 1024 * 1024
#: Files whose blocks a worker holds at once.
ROWS = 64


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(version_id, path, suffix, checksum, content)`` of the files below a path."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    checksum = F.sha2("content", 256)
    return rows.select(F.substring(checksum, 1, 32).alias("version_id"), "path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"), checksum.alias("checksum"), "content", F.col("modificationTime").alias("created_at"))


def split_acl(c: str):
    """The trimmed, non-empty names of a comma-separated list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def decode(content: bytes) -> str:
    """UTF-8, else Windows-1252, else Latin-1."""
    for name in ("utf-8-sig", "cp1252"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


class _Blocks(HTMLParser):
    """Headings, paragraphs, list items and tables in the order of the document; the last heading is their path."""

    KINDS = {"h1": "heading", "h2": "heading", "h3": "heading", "p": "paragraph", "li": "list_item", "table": "table"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, list[str], str]] = []
        self.open: str | None = None
        self.depth = 0
        self.held: list[str] = []
        self.hidden = 0
        self.heading: list[str] = []

    def flush(self) -> None:
        text = re.sub(r"[^\S\t\n]+", " ", "".join(self.held)).strip() if self.open == "table" else " ".join("".join(self.held).split())
        if self.open and text:
            kind = self.KINDS[self.open]
            if kind == "heading":
                self.heading = [text]
            self.found.append((kind, list(self.heading), text))
        self.open, self.held = None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template"):
            self.hidden += 1
        elif self.open == "table":
            self.depth += tag == "table"
            if tag == "tr" and self.held:
                self.held.append("\n")
            elif tag in ("td", "th") and self.held and self.held[-1] != "\n":
                self.held.append("\t")
        elif tag in self.KINDS:
            if not (tag == "p" and self.open == "li"):  # a paragraph inside an item is the item's text
                self.flush()
                self.open, self.depth = tag, 1
        elif tag == "br" and self.open:
            self.held.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.open == "table":
            self.depth -= 1
            if not self.depth:
                self.flush()
        elif tag == self.open and self.open != "table":
            self.flush()

    def handle_data(self, data):
        if self.open and not self.hidden:
            self.held.append(data)


def html_blocks(text: str) -> list[tuple[str, list[str], str]]:
    parser = _Blocks()
    parser.feed(text)
    parser.close()
    parser.flush()
    return parser.found


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if z.getinfo(name).file_size > MOST_UNPACKED:
        raise ValueError("a part of the file is too large")
    return ElementTree.fromstring(z.read(name))


def docx_blocks(content: bytes) -> list[tuple[str, list[str], str]]:
    """Headings and paragraphs with the last heading, and tables where they stand, as tab-joined rows."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = _part(z, "word/document.xml").find(f"{w}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    out, heading = [], []
    for e in body if body is not None else []:
        if e.tag == f"{w}p" and text(e):
            style = e.find(f"{w}pPr/{w}pStyle")
            if style is not None and re.match("(heading|title|t[ií]tulo)", style.get(f"{w}val", ""), re.I):
                heading = [text(e)]
                out.append(("heading", heading, text(e)))
            else:
                out.append(("paragraph", heading, text(e)))
        elif e.tag == f"{w}tbl":
            rows = ["\t".join(text(c) for c in r.findall(f"{w}tc")) for r in e.findall(f"{w}tr")]
            out.append(("table", heading, "\n".join(rows)))
    return out


def xlsx_blocks(content: bytes) -> list[tuple[str, list[str], str]]:
    """One table for each sheet: the non-empty cells of its rows, tab-joined."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in _part(z, "xl/sharedStrings.xml").findall(f"{m}si")] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name", "") for s in _part(z, "xl/workbook.xml").iter(f"{m}sheet")] if "xl/workbook.xml" in names else []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))
        out = []
        for i, name in enumerate(sheets):
            rows = []
            for r in _part(z, name).iter(f"{m}row"):
                cells = []
                for c in r.findall(f"{m}c"):
                    v = c.find(f"{m}v")
                    value = "".join(t.text or "" for t in c.iter(f"{m}t")) if c.get("t") == "inlineStr" else shared[int(v.text)] if v is not None and c.get("t") == "s" else v.text if v is not None else ""
                    if value:
                        cells.append(value)
                if cells:
                    rows.append("\t".join(cells))
            if rows:
                out.append(("table", [titles[i] if i < len(titles) else f"Sheet {i + 1}"], "\n".join(rows)))
    return out


def pdf_blocks(content: bytes) -> list[tuple[str, list[str], str]]:
    """One block for each page with text; needs the optional ``pypdf`` package."""
    from pypdf import PdfReader

    pages = ((p.extract_text() or "") for p in PdfReader(io.BytesIO(content)).pages)
    return [("page", [f"Page {i}"], re.sub(r"[ \t]+\n", "\n", t).strip()) for i, t in enumerate(pages, 1) if t.strip()]


def blocks_of(suffix: str, content: bytes) -> tuple[list[tuple[str, list[str], str]], str | None]:
    """A file's blocks and the reason for a manual review, if there is one."""
    try:
        if suffix in TEXT_SUFFIXES:
            return [("text", [], decode(content).strip())], None
        if suffix in HTML_SUFFIXES:
            return html_blocks(decode(content)), None
        if suffix in ("docx", "xlsx"):
            return (docx_blocks if suffix == "docx" else xlsx_blocks)(content), None
        if suffix == "pdf":
            return pdf_blocks(content), None
    except ImportError:
        return [], "extractor_not_installed"
    except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError):
        return [], "extraction_failed"
    return [], "unsupported_format"


def extract(files: DataFrame) -> DataFrame:
    """``files(version_id, suffix, content)`` to blocks; a file without any gives one empty row with its reason."""
    schema = pa.schema([("version_id", pa.string()), ("block_order", pa.int32()), ("block_type", pa.string()), ("page", pa.int32()), ("section_path", pa.list_(pa.string())), ("text", pa.string()), ("review_reason", pa.string())])

    def run(batches):
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            rows = []
            for version, suffix, content in zip(*[c.to_pylist() for c in b.columns], strict=True):
                found, reason = blocks_of(suffix or "", content or b"")
                found = [f for f in found if f[2].strip()]
                rows += [(version, i, kind, int(path[0][5:]) if kind == "page" else 1, path, text, None) for i, (kind, path, text) in enumerate(found)]
                if not found:
                    rows.append((version, 0, "none", None, [], None, reason or "no_text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return files.select("version_id", "suffix", F.col("content").cast("binary")).mapInArrow(run, BLOCKS)


def quality_gate(blocks: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """``(version_id, n_blocks, n_chars, review_required, review_reason)``: versions with less text than ``least`` wait for a person."""
    text = F.trim(F.coalesce("text", F.lit("")))
    rows = blocks.groupBy("version_id").agg(F.count_if(text != "").alias("n_blocks"), F.sum(F.length(text)).alias("n_chars"), F.max("review_reason").alias("reason"))
    short = F.col("n_chars") < least
    return rows.select("version_id", "n_blocks", "n_chars", short.alias("review_required"), F.when(short, F.coalesce("reason", F.lit("low_text_yield"))).alias("review_reason"))


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON fixture: an object with ``cases``, or a bare list; ``schema`` is that of a case."""
    raw = spark.read.text(path, wholetext=True)
    wrapped, bare = F.from_json("value", f"cases array<struct<{schema}>>")["cases"], F.from_json("value", f"array<struct<{schema}>>")
    return raw.select(F.explode(F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped)).alias("c")).select("c.*")
