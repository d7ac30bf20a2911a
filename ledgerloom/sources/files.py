"""Readers of whole files: word processor, spreadsheet, slides, delimited, text, JSON, XML, HTML and mail, with the standard library alone.

``read_files`` takes (path, content) as Spark's ``binaryFile`` source gives them and returns one row for each part of a file: blocks of text, cells
of tables, embedded objects, structured data, counts and warnings. A file that can't be read gives one ``error`` row, so that it
doesn't stop the others. Files are read one at a time by their task; a sheet is cut, with a warning, at ``MOST_CELLS`` cells.
"""

from __future__ import annotations

import csv
import email
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from email import policy
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import _parsed

MOST_CELLS = 100_000
#: Rows of parts and bytes of files after which a frame goes out.
FRAME_ROWS, FRAME_BYTES = 2000, 1 << 22
SCHEMA = "path string, part string, ix int, kind string, text string, sheet string, page int, row int, column int, metadata string"
#: What each ending is read as.
FORMATS = {
    "docx": "docx", "xlsx": "xlsx", "xlsm": "xlsx", "pptx": "pptx", "csv": "delimited", "tsv": "tabbed", "txt": "text", "md": "text", "log": "text", "ini": "text", "cfg": "text", "conf": "text",
    "yaml": "text", "yml": "text", "json": "json", "xml": "xml", "html": "html", "htm": "html", "eml": "eml",
}
#: Endings that need a program from outside: page images and portable documents, and old office files.
OUTSIDE = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "doc", "xls", "ppt", "odt", "ods", "odp", "rtf")


@dataclass
class Parts:
    """What a file holds, in order."""

    rows: list[dict] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)

    def add(self, part: str, kind: str, text: str, sheet: str | None = None, page: int | None = None, row: int | None = None, column: int | None = None, **metadata) -> None:
        ix = self.counts[part] = self.counts.get(part, 0) + 1
        known = {k: v for k, v in metadata.items() if v is not None}
        self.rows.append({"part": part, "ix": ix, "kind": kind, "text": text, "sheet": sheet, "page": page, "row": row, "column": column, "metadata": json.dumps(known, ensure_ascii=False, sort_keys=True) if known else None})

    def table(self, name: str, data: list[list], sheet: str | None = None, page: int | None = None) -> None:
        """Cells of a ragged table; missing ones are left out. The table's own row has its size and headers."""
        headers = ["" if x is None else str(x) for x in data[0]] if data else []
        self.add("table", name, " | ".join(headers), sheet, page, len(data), max(map(len, data), default=0))
        for r, values in enumerate(data, 1):
            for c, value in enumerate(values, 1):
                if value is not None:
                    self.add("cell", name, str(value), sheet, page, r, c)


def decoded(data: bytes) -> str:
    """The text of a file: by its byte order mark, else UTF-8, else the Western code page; never fails."""
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(encoding, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attribute(node: ET.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _all(node: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in node.iter() if _local(x.tag) == name]


def _children(node: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in node if _local(x.tag) == name]


def _text(node: ET.Element) -> str:
    """The runs of text under a node; breaks and tabs as white space."""
    out = []
    for x in node.iter():
        out.append({"t": x.text or "", "tab": "\t", "br": "\n", "cr": "\n"}.get(_local(x.tag), ""))
    return "".join(out).strip()


def read_docx(data: bytes, parts: Parts) -> None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        styles = {}
        if "word/styles.xml" in names:
            for s in _all(ET.fromstring(z.read("word/styles.xml")), "style"):
                title = _children(s, "name")
                styles[_attribute(s, "styleId")] = _attribute(title[0], "val") if title else None
        body = _children(ET.fromstring(z.read("word/document.xml")), "body")[0]
        for i, p in enumerate(_children(body, "p"), 1):
            style_id = next((_attribute(s, "val") for s in _all(p, "pStyle")), None)
            style = styles.get(style_id, style_id)
            low = (style or "").lower()
            kind = next((k for word, k in (("title", "title"), ("heading", "heading"), ("list", "list_item")) if word in low), "paragraph")
            if text := _text(p):
                parts.add("block", kind, text, row=i, style=style)
        for i, t in enumerate(_children(body, "tbl"), 1):
            parts.table(f"table_{i}", [[_text(c) for c in _children(r, "tc")] for r in _children(t, "tr")])
        for name in sorted(n for n in names if re.fullmatch(r"word/(header|footer)\d*\.xml", n)):
            for p in _all(ET.fromstring(z.read(name)), "p"):
                if text := _text(p):
                    parts.add("block", "header" if "header" in name else "footer", text)
        core = {}
        if "docProps/core.xml" in names:
            core = {_local(x.tag): x.text for x in ET.fromstring(z.read("docProps/core.xml"))}
        wanted = {"title": "title", "subject": "subject", "author": "creator", "keywords": "keywords", "comments": "description"}
        parts.add("structured", "core_properties", json.dumps({k: core.get(v) for k, v in wanted.items()}, ensure_ascii=False, sort_keys=True))


def _place(coordinate: str) -> tuple[int, int]:
    """Row and column of ``B12``."""
    letters = coordinate.rstrip("0123456789")
    column = 0
    for c in letters.upper():
        column = 26 * column + ord(c) - 64
    return int(coordinate[len(letters) :]), column


def _is_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    return bool(re.search("[dmyhs]", bare, re.I)) and not re.search("[0#]", bare.replace("00", "") if "s" in bare else bare)


def _number(raw: str, dated: bool) -> str:
    """A stored number as text; a date as ISO, counted in days from the end of 1899."""
    value = float(raw)
    if dated:
        at = datetime(1899, 12, 30) + timedelta(days=value)
        return at.isoformat()
    return str(int(value)) if value == int(value) and "." not in raw and "e" not in raw.lower() else str(value)


def read_xlsx(data: bytes, parts: Parts, most: int = MOST_CELLS) -> None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [_text(si) for si in _children(ET.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
        dated: list[bool] = []
        if "xl/styles.xml" in names:
            sheet = ET.fromstring(z.read("xl/styles.xml"))
            codes = {_attribute(n, "numFmtId"): _attribute(n, "formatCode") or "" for n in _all(sheet, "numFmt")}
            for block in _children(sheet, "cellXfs"):
                for xf in _children(block, "xf"):
                    f = _attribute(xf, "numFmtId") or "0"
                    dated.append(f in codes and _is_date(codes[f]) or f.isdigit() and (14 <= int(f) <= 22 or 45 <= int(f) <= 47))
        links = {_attribute(r, "Id"): _attribute(r, "Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in _all(ET.fromstring(z.read("xl/workbook.xml")), "sheet"):
            title, target = _attribute(s, "name"), links[_attribute(s, "id")].lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            _sheet(title, ET.fromstring(z.read(path)), _comments(z, path, names), shared, dated, parts, most)
        parts.add("count", "sheets", str(len(links) and len(_all(ET.fromstring(z.read("xl/workbook.xml")), "sheet"))))


def _comments(z: zipfile.ZipFile, path: str, names: set[str]) -> dict[str, str]:
    rels = posixpath.join(posixpath.dirname(path), "_rels", posixpath.basename(path) + ".rels")
    out = {}
    if rels in names:
        for r in ET.fromstring(z.read(rels)):
            if (_attribute(r, "Type") or "").endswith("/comments"):
                target = posixpath.normpath(posixpath.join(posixpath.dirname(path), _attribute(r, "Target")))
                for c in _all(ET.fromstring(z.read(target.lstrip("/"))), "comment"):
                    out[_attribute(c, "ref")] = _text(c)
    return out


def _sheet(title: str, root: ET.Element, comments: dict[str, str], shared: list[str], dated: list[bool], parts: Parts, most: int) -> None:
    values: dict[tuple[int, int], str] = {}
    formulas: dict[str, str] = {}
    for c in _all(root, "c"):
        at, kind = _attribute(c, "r"), _attribute(c, "t")
        raw = next((v.text for v in _children(c, "v")), None)
        formula = next((f.text for f in _children(c, "f") if f.text), None)
        if formula is not None:
            value = formulas[at] = "=" + formula
        elif kind == "s" and raw is not None:
            value = shared[int(raw)]
        elif kind == "inlineStr":
            value = _text(c)
        elif raw is None:
            continue
        elif kind in ("str", "e"):
            value = raw
        elif kind == "b":
            value = str(raw == "1")
        else:
            style = int(_attribute(c, "s") or 0)
            value = _number(raw, style < len(dated) and dated[style])
        values[_place(at)] = value
    rows, columns = (max((p[i] for p in values), default=0) for i in (0, 1))
    kept = rows
    if rows * columns > most:
        kept = max(1, most // max(1, columns))
        parts.add("warning", "truncated", f"Sheet {title!r} truncated to {kept} rows ({most} cell cap).", sheet=title)
    data = [[values.get((r, c)) for c in range(1, columns + 1)] for r in range(1, kept + 1)]
    for (r, c), v in sorted(values.items()):
        if r <= kept and v != "":
            parts.add("block", "cell", v, title, row=r, column=c)
    if data := [r for r in data if any(v not in (None, "") for v in r)]:
        parts.table(title, data, sheet=title)
    merged = [_attribute(m, "ref") for m in _all(root, "mergeCell")]
    parts.add("structured", "sheet", json.dumps({"max_row": rows, "max_column": columns, "merged_ranges": merged, "formulas": formulas, "comments": comments}, ensure_ascii=False, sort_keys=True), sheet=title)


def read_pptx(data: bytes, parts: Parts) -> None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        for i, name in enumerate(slides, 1):
            root = ET.fromstring(z.read(name))
            for shape in _all(root, "sp"):
                holder = next((_attribute(p, "type") for p in _all(shape, "ph")), None)
                if text := "\n".join(t for p in _all(shape, "p") if (t := _text(p))):
                    parts.add("block", "title" if holder in ("title", "ctrTitle") else "paragraph", text, page=i)
            for t in _all(root, "tbl"):
                parts.table(f"slide_{i}_table", [["\n".join(x for p in _all(c, "p") if (x := _text(p))) for c in _children(r, "tc")] for r in _children(t, "tr")], page=i)
            for picture in _all(root, "pic"):
                parts.add("object", "image", next((_attribute(n, "name") or "" for n in _all(picture, "cNvPr")), ""), page=i)
            rels = f"ppt/slides/_rels/{posixpath.basename(name)}.rels"
            for r in ET.fromstring(z.read(rels)) if rels in names else ():
                if (_attribute(r, "Type") or "").endswith("/notesSlide"):
                    notes = ET.fromstring(z.read(posixpath.normpath(posixpath.join("ppt/slides", _attribute(r, "Target")))))
                    body = [s for s in _all(notes, "sp") if any(_attribute(p, "type") == "body" for p in _all(s, "ph"))]
                    if text := "\n".join(t for s in body for p in _all(s, "p") if (t := _text(p))):
                        parts.add("block", "paragraph", text, page=i, notes=True)
        parts.add("count", "slides", str(len(slides)))


def sniffed(text: str) -> str:
    """The delimiter of a text among comma, semicolon, tab and bar; comma if none shows."""
    try:
        return csv.Sniffer().sniff(text[:8192], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_delimited(data: bytes, parts: Parts, delimiter: str | None = None, name: str = "table") -> None:
    text = decoded(data)
    rows = list(csv.reader(text.splitlines(), delimiter=delimiter or sniffed(text)))
    for r, row in enumerate(rows, 1):
        for c, value in enumerate(row, 1):
            if value.strip():
                parts.add("block", "cell", value, row=r, column=c)
    if rows:
        parts.table(name, rows)


def line_kind(line: str) -> str:
    if line.startswith("#"):
        return "heading"
    return "list_item" if re.match(r"(?:[-*+]|\d+[.)]) ", line) else "paragraph"


def read_text(data: bytes, parts: Parts) -> None:
    for i, line in enumerate(decoded(data).splitlines(), 1):
        if line := line.strip():
            parts.add("block", line_kind(line), line, row=i)


def read_json(data: bytes, parts: Parts) -> None:
    payload = json.loads(decoded(data))
    parts.add("block", "code", json.dumps(payload, ensure_ascii=False, indent=2), language="json")
    parts.add("structured", "json", json.dumps(payload, ensure_ascii=False))


def read_xml(data: bytes, parts: Parts) -> None:
    root = ET.fromstring(data)
    for i, text in enumerate((t.strip() for t in root.itertext() if t.strip()), 1):
        parts.add("block", "paragraph", text, row=i)
    parts.add("structured", "root_tag", root.tag)


def read_html(data: bytes, parts: Parts) -> None:
    parsed = _parsed(decoded(data))
    for tag, text in parsed.out:
        parts.add("block", "heading" if tag.startswith("h") else "list_item" if tag == "li" else "paragraph", text, tag=tag)
    tables: dict[int, dict[int, list[str]]] = {}
    for t, r, _, text in parsed.cells:
        tables.setdefault(t, {}).setdefault(r, []).append(text)
    for t, rows in sorted(tables.items()):
        parts.table(f"html_table_{t + 1}", [rows[r] for r in sorted(rows)])


def read_eml(data: bytes, parts: Parts) -> None:
    message = email.message_from_bytes(data, policy=policy.default)
    for key in ("Subject", "From", "To", "Cc", "Date", "Message-ID"):
        if value := message.get(key):
            parts.add("block", "key_value", f"{key}: {value}", key=key, value=str(value))
    bodies = [p for p in message.walk() if not p.is_multipart()]
    plain = any(p.get_content_type() == "text/plain" for p in bodies)
    for p in bodies:
        kind = p.get_content_type()
        if name := p.get_filename():
            parts.add("object", "attachment", name, mime_type=kind, size_bytes=len(p.get_payload(decode=True) or b""))
        elif kind == "text/plain" and (text := decoded(p.get_payload(decode=True) or b"").strip()):
            parts.add("block", "paragraph", text)
        elif kind == "text/html" and not plain:
            if text := "\n".join(t for _, t in _parsed(decoded(p.get_payload(decode=True) or b"")).out):
                parts.add("block", "paragraph", text)


def read_bytes(path: str, data: bytes, most_cells: int = MOST_CELLS) -> list[dict]:
    """The parts of one file; its ending names the reader."""
    parts = Parts()
    ending = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    form = FORMATS.get(ending)
    try:
        if form is None:
            raise ValueError(f"needs a program from outside: .{ending}" if ending in OUTSIDE else f"Unsupported file extension: .{ending}")
        if form == "xlsx":
            read_xlsx(data, parts, most_cells)
        elif form in ("delimited", "tabbed"):
            read_delimited(data, parts, "\t" if form == "tabbed" else None, path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
        else:
            {"docx": read_docx, "pptx": read_pptx, "text": read_text, "json": read_json, "xml": read_xml, "html": read_html, "eml": read_eml}[form](data, parts)
    except Exception as error:  # one bad file is a row, not the end of the job
        parts = Parts()
        parts.add("error", type(error).__name__, str(error)[:500])
    return parts.rows


def frames(batches: Iterator[pd.DataFrame], most_cells: int = MOST_CELLS) -> Iterator[pd.DataFrame]:
    """The parts of batches of files, many small files in a frame; a frame ends with the file that fills it."""
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    rows: list[dict] = []
    size = 0

    def frame() -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("ix", "page", "row", "column")})

    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            data = bytes(content) if content is not None else b""
            rows.extend({"path": path, **r} for r in read_bytes(path, data, most_cells))
            size += len(data)
            if len(rows) >= FRAME_ROWS or size >= FRAME_BYTES:
                yield frame()
                rows, size = [], 0
    if rows:
        yield frame()


def read_files(files: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """All parts of files given as (path, content); see the module's docstring. A null content is an empty file."""
    return files.select("path", "content").mapInPandas(lambda batches: frames(batches, most_cells), SCHEMA)


def read_folder(spark: SparkSession, folder: str, pattern: str = "*", most_cells: int = MOST_CELLS) -> DataFrame:
    """All files under a folder whose names match, found by Spark, so that the folder may be in any store."""
    return read_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder), most_cells)


def is_pdf(content: Column) -> Column:
    """Whether an upload begins as a portable document."""
    return F.coalesce(F.substr(content, F.lit(1), F.lit(5)) == F.lit(b"%PDF-"), F.lit(False))


def distinct_files(files: DataFrame) -> DataFrame:
    """The first path of each content, with the content's SHA-256."""
    return files.withColumn("sha256", F.sha2("content", 256)).groupBy("sha256").agg(F.min("path").alias("path"))


def sample_files(files: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` distinct files in an order that the seed fixes."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), "sha256"), 256)
    return distinct_files(files).orderBy(order, "path").limit(n)


def jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The good records of JSON lines, and one row of counts: total, and malformed ones."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    full = lines.select(F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    counts = full.agg(F.count("*").alias("records"), F.count("_corrupt_record").alias("malformed"))
    return full.where("_corrupt_record IS NULL").drop("_corrupt_record"), counts
