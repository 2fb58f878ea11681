"""File parsers over Spark's binaryFile source: (path, content) to text. Office formats are read with the standard library."""

from __future__ import annotations

import csv
import html
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from functools import partial
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowlark.functions.text import media_kind, parser_of
from knowlark.operators.chunk import chunked

GARBAGE, HEAD = 0.02, 4000
DROPPED = {"script", "style", "noscript", "iframe", "nav", "footer", "header", "aside"}
SCRIPTS = {"script", "style", "noscript", "iframe"}
BLOCKS = {"p", "div", "br", "li", "tr", "table", "section", "blockquote", "pre", "h1", "h2", "h3", "h4"}
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
MAX_MEDIA = 8 << 20
#: Rows of a table that a summary is made from.
SUMMARISED = 15


def garbage_ratio(text: str) -> float:
    head = text[:HEAD]
    return sum(c == "�" or (c < " " and c not in "\n\r\t") for c in head) / len(head) if head else 0.0


def decode(raw: bytes) -> str:
    """UTF-8, or GBK if that leaves too much garbage."""
    text = raw.decode("utf-8-sig", "replace")
    return raw.decode("gbk", "replace") if garbage_ratio(text) >= GARBAGE else text


class _Html(HTMLParser):
    """Collects text: each node of it trimmed and on a line, blocks after a line feed, headings and cells marked. dropped names the
    elements that go with all they hold."""

    def __init__(self, dropped: set[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title = ""
        self.inside: list[str] = []
        self.unwanted = dropped
        self.dropped = 0
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "title":
            self.in_title = True
        if tag not in VOID:
            self.inside.append(tag)
            self.dropped += tag in self.unwanted
        if self.dropped:
            return
        if tag in BLOCKS:
            self.out.append("\n")
        if tag in ("h1", "h2", "h3"):
            self.out.append("#" * int(tag[1]) + " ")
        if tag in ("td", "th"):
            self.out.append("| ")
        if tag == "tr":
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in self.inside:
            while self.inside:
                top = self.inside.pop()
                self.dropped -= top in self.unwanted
                if top in ("td", "th") and not self.dropped:
                    self.out.append(" ")
                if top == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.dropped and "head" not in self.inside:
            text = re.sub(r"\s+", " ", data).strip()
            if text:
                self.out.append(text + "\n")


def _read_html(source: str, dropped: set[str]) -> tuple[str, str]:
    """Title and body text."""
    parser = _Html(dropped)
    parser.feed(source)
    parser.close()
    return re.sub(r"\s+", " ", parser.title).strip(), "".join(parser.out)


def html_text(source: str) -> str:
    """`# title`, then the body's text: a line for each text node, blocks apart, headings marked, cells after bars; navigation and
    scripts dropped."""
    title, body = _read_html(source, DROPPED)
    return (f"# {title}\n\n{body}" if title else body).strip()


def parse_html(raw: bytes, name: str = "") -> str:
    declared = re.search(rb"charset\s*=\s*[\"']?([\w-]+)", raw[:4096], re.I)
    if declared:
        try:
            return html_text(raw.decode(declared[1].decode("ascii"), "replace"))
        except LookupError:
            pass
    return html_text(decode(raw))


def csv_rows(raw: bytes) -> list[list[str]]:
    """Rows of trimmed cells; a physical line is a row, `""` is a quote, and blank rows at the end go."""
    text = raw.decode("utf-8-sig", "replace")
    if "�" in text and not raw.startswith(b"\xef\xbb\xbf"):
        text = raw.decode("gbk", "replace")
    rows = [[c.strip() for c in next(csv.reader([line]), [""])] or [""] for line in re.split(r"\r\n|\r|\n", text)]
    while rows and not any(rows[-1]):
        rows.pop()
    return rows


def markdown(sheet: str, rows: list[list[str]], batch: int = 1000) -> list[str]:
    if not rows:
        return [f"### Sheet: {sheet}\n\n（空表）"]
    head, body = rows[0], rows[1:]
    top = f"### Sheet: {sheet}\n\n| " + " | ".join(head) + " |\n|" + " --- |" * len(head) + "\n"
    cell = lambda c: c.replace("\n", " ").replace("|", "\\|")
    line = lambda r: "| " + " | ".join(cell(r[k]) if k < len(r) else "" for k in range(len(head))) + " |"
    return [top + "\n".join(map(line, body[k : k + batch])) for k in range(0, max(1, len(body)), batch)]


def json_lines(sheet: str, rows: list[list[str]]) -> list[str]:
    """One JSON object per row: the sheet, then cells by the header in its order. Short rows are padded, cells beyond the header dropped; of a
    repeated name the last cell stays."""
    head = rows[0] if rows else []
    return [json.dumps({"sheet": sheet} | {h: r[k] if k < len(r) else "" for k, h in enumerate(head)}, ensure_ascii=False, separators=(",", ":")) for r in rows[1:]]


def table_chunks(name: str, raw: bytes, strategy: str, summarise: Callable[[str], str] | None = None) -> list[str] | None:
    """Chunks of a table file by strategy: table_json gives a chunk for each row; table_summary puts a model's summary of the first 15
    before them, if there is one. None for other strategies (the text is then split like other texts) and other files."""
    if strategy not in ("table_json", "table_summary"):
        return None
    if name.lower().endswith(".csv"):
        rows = json_lines("CSV", csv_rows(raw))
    elif name.lower().endswith(".xlsx"):
        rows = [line for sheet, cells in xlsx_sheets(raw) for line in json_lines(sheet, cells)]
    else:
        return None
    if strategy == "table_summary" and rows and summarise is not None:
        sample = "\n".join(f"{k}. {r}" for k, r in enumerate(rows[:SUMMARISED], 1))
        try:
            told = (summarise(f"{posixpath.basename(name)}\n{sample}") or "").strip()
        except Exception:  # noqa: BLE001  rows go in without a summary
            told = ""
        rows = [f"【表格摘要】{told}", *rows] if told else rows
    return rows


def parse_csv(raw: bytes, name: str = "") -> str:
    return "\n\n".join(markdown(posixpath.basename(name), csv_rows(raw)))


def _texts(node: ET.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter() if t.tag.endswith("}" + tag))


def _tag(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def parse_docx(raw: bytes, name: str = "") -> str:
    """Paragraphs outside tables that aren't blank, then tables, cells apart by tabs."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))[0]
    lines = [t for p in body if _tag(p) == "p" and (t := _texts(p, "t")).strip()]
    for table in (x for x in body if _tag(x) == "tbl"):
        for row in (x for x in table.iter() if _tag(x) == "tr"):
            lines.append("\t".join("\n".join(_texts(p, "t") for p in cell.iter() if _tag(p) == "p").strip() for cell in row if _tag(cell) == "tc"))
    return "\n".join(lines).strip()


def parse_pptx(raw: bytes, name: str = "") -> str:
    """`## 第 n 页` for each slide, then its shapes' texts."""
    pack = zipfile.ZipFile(io.BytesIO(raw))
    slides = sorted((n for n in pack.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for k, slide in enumerate(slides, 1):
        root = ET.fromstring(pack.read(slide))
        shapes = ["\n".join(_texts(p, "t") for p in s.iter() if _tag(p) == "p").strip() for s in root.iter() if _tag(s) == "txBody"]
        out.append("\n".join([f"## 第 {k} 页", *filter(None, shapes)]))
    return "\n\n".join(out)


def xlsx_sheets(raw: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet, rows of cells as text): dates ISO, whole numbers without a point, formulas by their cached value."""
    pack = zipfile.ZipFile(io.BytesIO(raw))
    names = set(pack.namelist())
    shared = [_texts(si, "t") for si in ET.fromstring(pack.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    dates: list[bool] = []
    if "xl/styles.xml" in names:
        styles = ET.fromstring(pack.read("xl/styles.xml"))
        custom = {n.get("numFmtId"): bool(re.search(r"[ymdhs]", re.sub(r"\[[^\]]*\]|\"[^\"]*\"", "", n.get("formatCode", "")), re.I)) for n in styles.iter() if _tag(n) == "numFmt"}
        for xfs in (x for x in styles if _tag(x) == "cellXfs"):
            dates = [custom.get(x.get("numFmtId"), x.get("numFmtId") in {*map(str, range(14, 23)), "45", "46", "47"}) for x in xfs]
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(pack.read("xl/_rels/workbook.xml.rels"))}

    def value(c: ET.Element) -> str:
        kind, v = c.get("t"), next((x.text or "" for x in c if _tag(x) == "v"), None)
        if kind == "inlineStr":
            return _texts(c, "t")
        if v is None:
            return ""
        if kind == "s":
            return shared[int(v)]
        if kind == "b":
            return "true" if v == "1" else "false"
        if kind in ("str", "e"):
            return v if kind == "str" and not any(_tag(x) == "f" for x in c) else ""
        number, style = float(v), int(c.get("s") or 0)
        if style < len(dates) and dates[style]:
            day = datetime(1899, 12, 30) + timedelta(days=number)
            return day.date().isoformat() if number == int(number) else day.isoformat(sep=" ", timespec="seconds")
        return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)

    out = []
    for sheet in (x for x in ET.fromstring(pack.read("xl/workbook.xml")).iter() if _tag(x) == "sheet"):
        target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        root = ET.fromstring(pack.read(posixpath.normpath(posixpath.join("xl", target)).lstrip("/") if not target.startswith("/") else target[1:]))
        rows = []
        for row in (x for x in root.iter() if _tag(x) == "row"):
            cells: list[str] = []
            for k, c in enumerate(x for x in row if _tag(x) == "c"):
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                at = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(letters[0]))) - 1 if letters else k
                cells += [""] * (at - len(cells)) + [value(c)]
            rows.append(cells)
        while rows and not any(x.strip() for x in rows[-1]):
            rows.pop()
        out.append((sheet.get("name"), rows))
    return out


def parse_xlsx(raw: bytes, name: str = "") -> str:
    return "\n\n".join(part for sheet, rows in xlsx_sheets(raw) for part in markdown(sheet, rows))


def parse_epub(raw: bytes, name: str = "") -> str:
    """`# title`, then the spine's chapters in order as `## 第 n 章：title` and text."""
    pack = zipfile.ZipFile(io.BytesIO(raw))
    names = pack.namelist()
    try:
        place = next(x.get("full-path") for x in ET.fromstring(pack.read("META-INF/container.xml")).iter() if _tag(x) == "rootfile")
    except (KeyError, StopIteration, ET.ParseError):
        place = next(n for n in names if n.endswith(".opf"))
    package = ET.fromstring(pack.read(place))
    title = next((x.text or "" for x in package.iter() if _tag(x) == "title"), "").strip()
    items = {x.get("id"): x.get("href") for x in package.iter() if _tag(x) == "item"}
    out = [f"# {title}"] if title else []
    n = 0
    for ref in (x.get("idref") for x in package.iter() if _tag(x) == "itemref"):
        path = posixpath.normpath(posixpath.join(posixpath.dirname(place), html.unescape(items.get(ref) or "")))
        if path not in names:
            continue
        chapter, body = _read_html(pack.read(path).decode("utf-8", "replace"), SCRIPTS)
        n += 1  # an empty chapter counts
        text = re.sub(r"\n{2,}", "\n", body).strip()
        if text:
            out.append(f"## 第 {n} 章：{chapter}\n{text}" if chapter else f"## 第 {n} 章\n{text}")
    return "\n\n".join(out)


def parse_text(raw: bytes, name: str = "") -> str:
    return decode(raw)


def unavailable(kind: str) -> Callable[[bytes, str], str]:
    def parse(raw: bytes, name: str = "") -> str:
        raise ValueError(f"no {kind} reader is installed; register one in PARSERS")

    return parse


#: Parsers by kind. pdf and the old binary formats need a library: put a function here to add one.
PARSERS: dict[str, Callable[[bytes, str], str]] = {"text": parse_text, "html": parse_html, "table": parse_csv, "docx": parse_docx, "pptx": parse_pptx, "epub": parse_epub, "pdf": unavailable("PDF")}


def parse_file(name: str, kind: str | None, raw: bytes) -> tuple[str | None, str | None]:
    """(text, error) of a file; never raises, so one bad file doesn't end a job."""
    if kind is None:
        return None, "unsupported file type"
    try:
        if name.lower().endswith(".xlsx"):
            return parse_xlsx(raw, name), None
        if name.lower().endswith((".xls", ".doc")):
            return unavailable(name.rpartition(".")[2])(raw, name), None
        return PARSERS[kind](raw, name), None
    except Exception as x:  # noqa: BLE001  whatever a broken file raises is its row's error
        return None, f"{type(x).__name__}: {x}"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [parse_file(n, k, raw) for n, k, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["path", "parser", "text", "error"])


def parse(files: DataFrame) -> DataFrame:
    """(path, parser, text, error) of files (path, content), as spark.read.format("binaryFile") gives them."""
    return files.select("path", parser_of(F.col("path")).alias("parser"), "content").mapInArrow(_parsed, "path string, parser string, text string, error string")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return parse(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def _html(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([html_text(x or "") for x in batch.column(1).to_pylist()], pa.string())], ["page_id", "text"])


def pages_text(pages: DataFrame) -> DataFrame:
    """(page_id, text) of pages (page_id, html)."""
    return pages.select("page_id", "html").mapInArrow(_html, "page_id long, text string")


def _csv_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, head, cells) of CSV files' rows; a file's header is its first row and goes along with each other one."""
    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            head, *rows = csv_rows(raw) or [[]]
            lists = pa.list_(pa.string())
            for k in range(0, max(1, len(rows)), 10_000):
                some = rows[k : k + 10_000] or [None]  # a file of a header alone still tells its columns
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(some), pa.string()), pa.array([head] * len(some), lists), pa.array(some, lists)], ["path", "head", "cells"])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files as trimmed strings, by the rules of csv_rows(), each by its own header: columns of the first path's header, then those that
    only others have, in their order by name; a cell that a row lacks is empty, cells beyond the header are dropped, and of columns with
    one name the last counts."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_csv_cells, "path string, head array<string>, cells array<string>")
    first = rows.orderBy("path").select("head").first()
    own = list(dict.fromkeys(first["head"] if first else []))
    # As many as the result has columns.
    others = sorted(r["name"] for r in rows.select(F.explode("head").alias("name")).distinct().collect() if r["name"] not in own)
    back = F.reverse("head")
    cell = lambda n: F.get("cells", (F.size("head") - F.array_position(back, n)).cast("int"))  # noqa: E731  null where the name isn't there: its place is beyond
    there = rows.where(F.col("cells").isNotNull())
    return there.select(*(F.coalesce(F.when(F.array_contains("head", n), cell(n)), F.lit("")).alias(n) for n in own + others))


def file_chunks(files: DataFrame, strategy: str = "table_text", summarise: Callable[[str], str] | None = None, multimodal: bool = False) -> DataFrame:
    """(path, position, content, error) of files (path, content): rows of tables by strategy, whole texts of other files. Media files are
    an error where the knowledge base is of text only."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, kind, parser, raw in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if kind != "other" and not multimodal:
                    rows.append((path, 0, None, "media in a knowledge base of text only"))
                    continue
                try:
                    table = table_chunks(path, raw, strategy, summarise)
                except Exception as x:  # noqa: BLE001  whatever a broken file raises is its row's error
                    rows.append((path, 0, None, f"{type(x).__name__}: {x}"))
                    continue
                rows += [(path, 0, *parse_file(path, parser, raw))] if table is None else [(path, k, t, None) for k, t in enumerate(table)]
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["path", "position", "content", "error"])

    typed = files.select("path", media_kind(F.col("path")).alias("kind"), parser_of(F.col("path")).alias("parser"), "content")
    return typed.mapInArrow(each, "path string, position long, content string, error string")


def file_pieces(files: DataFrame, table: str = "table_text", strategy: str = "fixed", size: int = 600, overlap: int = 100, summarise: Callable[[str], str] | None = None, multimodal: bool = False) -> DataFrame:
    """(path, position, content, parent, error) of files (path, content) as a knowledge base stores them: texts, and tables as Markdown
    (`table_text`), go through the splitter by strategy; tables by `table_json` or `table_summary` stay a piece for each row. A file that
    fails has one row, with the error alone."""
    found = file_chunks(files, table, summarise, multimodal)
    rows = parser_of(F.col("path")) == "table" if table in ("table_json", "table_summary") else F.lit(False)
    as_is = F.col("error").isNotNull() | F.coalesce(rows, F.lit(False))
    kept = found.where(as_is).select("path", F.col("position").cast("int").alias("position"), "content", F.lit(None).cast("string").alias("parent"), "error")
    texts = found.where(~as_is).select(F.col("path").alias("doc_id"), F.col("content").alias("text"))
    cut = chunked(texts, strategy, size, overlap).select(F.col("doc_id").alias("path"), F.col("position").cast("int").alias("position"), "content", "parent", F.lit(None).cast("string").alias("error"))
    return kept.unionByName(cut)


def describe_media(files: DataFrame, model: Callable[[bytes, str], str] | None = None) -> DataFrame:
    """(path, text): a model's description of media files (path, content); the name alone for files over 8 MB and failures."""

    def each(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = posixpath.basename(path)
                text = f"媒体文件：{name}"
                if model is not None and len(raw) <= MAX_MEDIA:
                    try:
                        text = model(raw, name) or text
                    except Exception:  # noqa: BLE001  the name stands in for any failure
                        pass
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["path", "text"])

    return files.select("path", "content").mapInArrow(partial(each), "path string, text string")
