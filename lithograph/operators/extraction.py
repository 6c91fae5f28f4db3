"""Text, headings and tables of files, by what the standard library reads; other types are registered by callers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithograph.operators.chunking import PAGES
from lithograph.operators.metadata import resolved_type

# What is printable in old word files, names of styles in them, and the least text that is of use.
WIDE_RUN = re.compile(rb"(?:[\x20-\x7E\xA0-\xFF]\x00){4,}")
STYLE_NAMES = re.compile(r"(?i)^(Normal|Heading \d|Times New Roman|Arial|Symbol|Default Paragraph Font|Table Normal|No List)$")
LEAST_LINE, LEAST_TEXT = 3, 200
HEADING_GAP, HEADING_CHARS = 0.5, 150
SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")

EXTRACTED = f"status string, reason string, pages {PAGES}"
Extractor = Callable[[bytes], tuple[str, str | None, list]]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _page(text: str, headings: list, tables: list) -> dict:
    return {"page_number": 1, "text": text, "headings": headings, "tables": [{"rows": t} for t in tables]}


def _text(node) -> str:
    """Text of a paragraph or cell; tabs and breaks as such, paragraphs as lines."""
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    one = lambda p: "".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in p.iter())
    own = [node] if node.tag == f"{_W}p" else node.findall(f"{_W}p")
    return "\n".join(map(one, own)).strip()


def _cells(row, above: list[str]) -> list[str]:
    """Cells of a table row: one over several columns is repeated, one that goes on from above has the text above."""
    out: list[str] = []
    for cell in row.findall(f"{_W}tc"):
        span, merge = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
        goes_on = merge is not None and merge.get(f"{_W}val", "continue") == "continue" and len(out) < len(above)
        text = above[len(out)] if goes_on else _text(cell)
        out += [text] * int(span.get(f"{_W}val", "1") if span is not None else 1)
    return out


def docx(content: bytes) -> tuple[str, str | None, list]:
    """Paragraphs, headings by the names of their styles, and tables of a word file, as one page."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        styles = ElementTree.fromstring(archive.read("word/styles.xml")) if "word/styles.xml" in archive.namelist() else []
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        return "failed", f"not a readable word file: {e}", []
    names = {s.get(f"{_W}styleId"): s.find(f"{_W}name").get(f"{_W}val", "") for s in styles if s.find(f"{_W}name") is not None}
    lines, headings, tables = [], [], []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p" and (text := _text(node)):
            lines.append(text)
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = names.get(style.get(f"{_W}val"), style.get(f"{_W}val", "")) if style is not None else ""
            if level := re.match(r"(?i)heading (\d)", name):
                headings.append({"text": text, "rank": int(level[1]) - 1})
        elif node.tag == f"{_W}tbl":
            grid: list[list[str]] = []
            for row in node.findall(f"{_W}tr"):
                grid.append(_cells(row, grid[-1] if grid else []))
            tables += [grid] if grid else []
    if not lines and not tables:
        return "failed", "no text and no tables", []
    return "ok", None, [_page("\n".join(lines), headings, tables)]


def legacy_doc(content: bytes) -> tuple[str, str | None, list]:
    """Lines of the two-byte text in an old word file, each once in order; structure is lost, so the status is partial."""
    if not content.startswith(SIGNATURE):
        return "failed", "not an old word file", []
    runs = (m[0].decode("utf-16-le") for m in WIDE_RUN.finditer(content))
    lines = (x.strip() for run in runs for x in re.split(r"[\r\v\x00]+", run))
    kept = dict.fromkeys(x for x in lines if len(x) >= LEAST_LINE and not STYLE_NAMES.match(x))
    text = "\n".join(kept)
    if len(text) < LEAST_TEXT:
        return "failed", f"only {len(text)} characters of text found", []
    return "partial", "text without headings, tables or pages", [_page(text, [], [])]


EXTRACTORS: dict[str, Extractor] = {"docx": docx, "doc": legacy_doc}


def extract(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """(source_ref, filename, file_type, status, reason, pages) of files (source_ref, filename, content).

    The type by name and signature chooses the extractor, those given beside EXTRACTORS; types without one, page
    layouts among them, are unsupported. A file that an extractor cannot read fails alone.
    """
    known = EXTRACTORS | (extractors or {})

    def one(kind: str, content: bytes | None) -> tuple[str, str | None, list]:
        if kind not in known:
            return "unsupported", f"no extractor for {kind} files", []
        try:
            return known[kind](bytes(content or b""))
        except Exception as e:  # a broken file must not end the run
            return "failed", f"{type(e).__name__}: {e}", []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [one(k, c) for k, c in zip(pdf["file_type"], pdf["content"], strict=True)]
            out = pdf[["source_ref", "filename", "file_type"]].copy()
            out["status"], out["reason"], out["pages"] = ([f[i] for f in found] for i in range(3))
            yield out

    typed = files.select("source_ref", "filename", resolved_type(F.col("filename"), F.col("content")).alias("file_type"), "content")
    return typed.mapInPandas(run, f"source_ref string, filename string, file_type string, {EXTRACTED}")


def headings_by_size(lines: DataFrame) -> DataFrame:
    """(page_id, pos, text, rank): lines of a page that are set larger than its body, rank 0 for the largest size.

    lines: (page_id, pos, text, size). The body's size is the upper median of the page's lines.
    """
    body = lines.groupBy("page_id").agg(F.sort_array(F.collect_list("size")).alias("sizes")).select("page_id", F.get("sizes", F.floor(F.size("sizes") / 2).cast("int")).alias("body"))
    larger = lines.join(body, "page_id").filter(F.col("size") > F.col("body") + HEADING_GAP)
    rank = F.dense_rank().over(Window.partitionBy("page_id").orderBy(F.desc("size"))) - 1
    return larger.withColumn("rank", rank).filter(F.length("text") < HEADING_CHARS).select("page_id", "pos", "text", "rank")


def page_counts(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, chars, empty_pages) of pages (doc_id, text): their number, their length, and how many have no text."""
    blank = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", 1)
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count(blank).alias("empty_pages"))
