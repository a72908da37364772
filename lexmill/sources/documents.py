"""Corpora from files: plain text, Markdown, word-processor files, tables and archives."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.errors import CorpusError
from lexmill.functions import text as X

ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
TEXT_HINTS = ("text", "texto", "transcricao", "transcription", "transcript", "content", "conteudo", "resposta", "answer")
ID_NAMES = ("id", "file", "doc_id", "documento")
PLAIN, MARKDOWN, TABLES = (".txt", ".text"), (".md", ".markdown"), (".csv", ".tsv", ".xlsx", ".xls")
OFFICE = (".docx", ".odt", ".pdf")
KNOWN = PLAIN + MARKDOWN + TABLES + OFFICE
_DOCS = "name string, uci_id string, text string, variables map<string,string>, kind string"


def decode(content: bytes) -> str:
    """The text in the first encoding that reads it."""
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise CorpusError("no encoding reads the file")


def docx_text(content: bytes) -> str:
    """Paragraphs of the body, one a line; tables are left out."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{w}body")  # noqa: S314
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in (body if body is not None else []) if p.tag == f"{w}p")


def odt_text(content: bytes) -> str:
    """Paragraphs and headings, one a line."""
    t = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("content.xml"))  # noqa: S314
    return "\n".join("".join(x.itertext()) for x in root.iter() if x.tag in (f"{t}p", f"{t}h"))


def pdf_text(content: bytes) -> str:
    """Text of a PDF, where the optional reader is installed."""
    try:
        from pdfminer.high_level import extract_text  # noqa: PLC0415
    except ModuleNotFoundError as error:
        raise CorpusError("reading PDF needs pdfminer.six") from error
    return extract_text(io.BytesIO(content))


def xlsx_rows(content: bytes) -> list[list[str]]:
    """Cells of the first sheet as strings."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).findall(f"{m}si")]  # noqa: S314
        sheet = ElementTree.fromstring(archive.read("xl/worksheets/sheet1.xml"))  # noqa: S314
    rows = []
    for row in sheet.iter(f"{m}row"):
        cells: list[str] = []
        for cell in row.findall(f"{m}c"):
            letters = re.match(r"[A-Z]*", cell.get("r", "")).group()  # type: ignore[union-attr]
            place = 0
            for c in letters:
                place = place * 26 + ord(c) - 64
            cells += [""] * max(0, place - 1 - len(cells))
            value = cell.find(f"{m}v")
            if cell.get("t") == "s" and value is not None:
                cells.append(shared[int(value.text or 0)])
            elif cell.get("t") == "inlineStr":
                cells.append("".join(t.text or "" for t in cell.iter(f"{m}t")))
            else:
                cells.append(value.text or "" if value is not None else "")
        rows.append(cells)
    return rows


def table_rows(name: str, content: bytes) -> list[dict[str, str]]:
    """Rows of a table file as strings; nulls are empty."""
    suffix = PurePosixPath(name).suffix.lower()
    if suffix in (".xlsx", ".xls"):
        rows = xlsx_rows(content)
    else:
        text = decode(content)
        first = text.split("\n", 1)[0]
        delimiter = "\t" if suffix == ".tsv" else max(",;\t|", key=lambda d: (first.count(d), -",;\t|".index(d)))
        rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))
    rows = [r for r in rows if any(c.strip() for c in r)]
    if len(rows) < 2:
        raise CorpusError(f"{name} has no row")
    header = [c.strip() for c in rows[0]]
    return [{h: (r[i] if i < len(r) else "") for i, h in enumerate(header) if h} for r in rows[1:]]


def text_column(rows: list[dict[str, str]], named: str | None = None) -> str:
    """The column that holds the text: as named, by a usual name, or the longest on average."""
    columns = list(rows[0])
    if named:
        if named not in columns:
            raise CorpusError(f"no column {named!r}")
        return named
    lower = {c.lower(): c for c in columns}
    for hint in TEXT_HINTS:
        if hint in lower:
            return lower[hint]
    return max(columns, key=lambda c: sum(len(r[c]) for r in rows))


def detect_text_column(df: DataFrame) -> str:
    """The same for a DataFrame: only mean lengths come to the driver."""
    strings = [c for c, kind in df.dtypes if kind == "string"]
    if not strings:
        raise CorpusError("no string column")
    lower = {c.lower(): c for c in strings}
    for hint in TEXT_HINTS:
        if hint in lower:
            return lower[hint]
    means = df.agg(*[F.coalesce(F.avg(F.length(c)), F.lit(0.0)).alias(c) for c in strings]).first()
    return max(strings, key=lambda c: means[c])


def _table_documents(name: str, content: bytes, named: str | None) -> Iterator[tuple]:
    rows = table_rows(name, content)
    column = text_column(rows, named)
    stem = PurePosixPath(name).stem
    lower = {c.lower(): c for c in rows[0]}
    key = next((lower[x] for x in ID_NAMES if x in lower), None)
    for i, row in enumerate(rows, start=1):
        variables = {k: v for k, v in row.items() if k not in (column, key)}
        yield name, (row[key] if key else "") or f"{stem}_lin{i:04d}", row[column], variables, "table"


def _file_documents(name: str, content: bytes, named: str | None) -> Iterator[tuple]:
    suffix, stem = PurePosixPath(name).suffix.lower(), PurePosixPath(name).stem
    if suffix in TABLES:
        yield from _table_documents(name, content, named)
        return
    if suffix == ".docx":
        text = docx_text(content)
    elif suffix == ".odt":
        text = odt_text(content)
    elif suffix == ".pdf":
        text = pdf_text(content)
    else:
        text = decode(content)
    yield name, stem, text, {}, "markdown" if suffix in MARKDOWN else "text"


def _members(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Files of an archive by their own names; other archives and paths that leave it are skipped."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for info in archive.infolist():
            path = PurePosixPath(info.filename)
            if info.is_dir() or ".." in path.parts or path.is_absolute() or path.name == "metadata.csv":
                continue
            if path.suffix.lower() in KNOWN:
                yield path.name, archive.read(info)


def parse_metadata(text: str) -> dict[str, dict[str, str]]:
    """Variables by file name; the header is the row with a cell ``file``, whatever stands above it."""
    delimiter = ";" if text.count(";") >= text.count(",") else ","
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))
    for i, row in enumerate(rows):
        names = [c.strip() for c in row]
        key = next((k for k, c in enumerate(names) if c.lower() == "file"), None)
        if key is not None:
            return {
                r[key].strip(): {n: r[k].strip() for k, n in enumerate(names) if n and k != key and k < len(r)}
                for r in rows[i + 1 :]
                if key < len(r) and r[key].strip()
            }
    raise CorpusError("the metadata have no column 'file'")


def import_directory(spark: SparkSession, folder: str, named: str | None = None, drop_speakers: tuple[str, ...] | None = None) -> DataFrame:
    """(uci_id, text, variables) of all documents of a folder, not of its subfolders.

    Files are read and parsed by the executors.  Files whose names start with
    ``metadata`` aren't documents; ``metadata.csv`` gives variables by file name,
    and files it doesn't name have their own stem as ``source``.  Moderators'
    turns and transcription artefacts are removed from text files, not from rows
    of tables.  Two documents with one id are an error.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    files = files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    meta = files.where(F.lower("name") == "metadata.csv").select("content").first()
    variables = parse_metadata(decode(bytes(meta["content"]))) if meta else {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                parts = _members(content) if name.lower().endswith(".zip") else [(name, content)]
                for member, data in parts:
                    out += _file_documents(member, data, named)
            yield pd.DataFrame(out, columns=["name", "uci_id", "text", "variables", "kind"])

    wanted = F.lower("name").rlike(r"(?:" + "|".join(re.escape(s) for s in (*KNOWN, ".zip")) + r")$") & ~F.lower("name").startswith("metadata")
    docs = files.where(wanted).select("name", "content").mapInPandas(run, _DOCS)
    rows = spark.createDataFrame([(k, v) for k, v in variables.items()], "mname string, mvars map<string,string>")
    docs = docs.join(rows, F.col("name") == F.col("mname"), "left")
    attached = F.when(F.col("kind") == "table", F.col("variables")).otherwise(
        F.coalesce("mvars", F.create_map(F.lit("source"), F.regexp_replace("name", r"\.[^.]*$", "")))
    )
    plain = F.when(F.col("kind") == "markdown", X.strip_markdown(F.col("text"))).otherwise(F.col("text"))
    turns, _ = X.filter_turns(plain, X.MODERATORS if drop_speakers is None else drop_speakers)
    cleaned = F.when(F.col("kind") == "table", F.col("text")).otherwise(X.clean_transcript(turns))
    out = docs.select("uci_id", cleaned.alias("text"), attached.alias("variables")).cache()
    if out.isEmpty():
        raise CorpusError(f"no document in {folder}")
    twice = out.groupBy("uci_id").count().where("count > 1").first()
    if twice:
        raise CorpusError(f"several documents are called {twice['uci_id']!r}")
    return out.orderBy("uci_id")


def documents_table(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    """A Parquet table of documents, its columns but id and text as variables."""
    rows = spark.read.parquet(f"{folder}/{table}.parquet")
    others = [c for c in rows.columns if c not in ("doc_id", "text")]
    variables = F.create_map(*[x for c in others for x in (F.lit(c), F.col(c).cast("string"))])
    return rows.select(F.col("doc_id").cast("string").alias("uci_id"), "text", variables.alias("variables"))
