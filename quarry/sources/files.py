"""Document and workbook sources, read as distributed binary files, and the sinks of reports."""

from __future__ import annotations

import csv
import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quarry.functions.text import SPACES

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, root: str, pattern: str = "*", skip: list[str] | None = None) -> DataFrame:
    """(path, name, size, modified, fingerprint, content) of the files under a folder, but for those whose name has a part of ``skip``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    name = F.substring_index("path", "/", -1)
    out = df.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("fingerprint"), "content")
    for s in ["~$", "._", *(skip or [])]:
        out = out.where(~F.lower("name").contains(s.lower()))
    return out


def decode_text(content: Column) -> Column:
    """UTF-8 with or without mark, else Windows-1251, whose bytes are translated one by one as the JVM functions lack the set."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    high = "".join(map(chr, range(0x80, 0x100)))
    cp1251 = "".join(bytes([b]).decode("cp1251", "replace") for b in range(0x80, 0x100))
    return F.regexp_replace(F.coalesce(utf8, F.translate(F.decode(content, "ISO-8859-1"), high, cp1251)), "^\\uFEFF", "")


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n


def workbook_cells(data: bytes) -> list[tuple[str, int, int, int, str]]:
    """(sheet, sheet_order, row_no, col_no, value) of the non-empty cells of an XLSX file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for order, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"), 1):
            target = targets[sheet.get(f"{_RELATION}id")].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            row_no = 0
            for row in ElementTree.fromstring(z.read(part)).iter(f"{_SHEET}row"):
                row_no = int(row.get("r", row_no + 1))
                col_no = 0
                for c in row.iter(f"{_SHEET}c"):
                    col_no = _column(c.get("r", "")) or col_no + 1
                    kind, v = c.get("t"), c.find(f"{_SHEET}v")
                    if kind == "s" and v is not None:
                        value = shared[int(v.text)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                    else:
                        value = v.text if v is not None else None
                    if value not in (None, ""):
                        out.append((sheet.get("name"), order, row_no, col_no, value))
    return out


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, data in zip(batch["name"], batch["content"], strict=True):
            try:
                rows = [(name, *c, None) for c in workbook_cells(bytes(data))]
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError) as e:
                rows = [(name, None, None, None, None, None, type(e).__name__)]
            yield pd.DataFrame(rows, columns=["workbook", "sheet", "sheet_order", "row_no", "col_no", "value", "fault"]).astype(object).where(lambda x: x.notna(), None)


def xlsx_cells(found: DataFrame) -> DataFrame:
    """Cells of all workbooks in long form; an unreadable file gives one row with its fault."""
    return found.select("name", "content").mapInPandas(_cells, "workbook string, sheet string, sheet_order int, row_no int, col_no int, value string, fault string")


def block_rows(cells: DataFrame) -> DataFrame:
    """Rows of the blocks of a sheet in long-to-wide form, with block number, skill and dimension filled down.

    A block begins at a row whose first cell is a number sign, with a cell ``skills`` and a cell
    ``х``; the next row holds the level labels. Skill (second column) and dimension (third) are
    inherited from above where blank, and flagged.
    """
    c = cells.where("fault is null").withColumn("value", F.trim(F.regexp_replace("value", SPACES, " ")))
    row = ["workbook", "sheet", "row_no"]
    r = c.groupBy(*row).agg(F.map_from_entries(F.collect_list(F.struct("col_no", "value"))).alias("cells"), F.collect_set(F.lower("value")).alias("low"))
    r = r.withColumn("head", (F.lower(F.col("cells")[1]).isin("№", "n") & F.array_contains("low", "skills") & (F.array_contains("low", "х") | F.array_contains("low", "x"))).cast("int"))
    sheet = W.partitionBy("workbook", "sheet").orderBy("row_no")
    r = r.withColumn("block_no", F.sum(F.coalesce("head", F.lit(0))).over(sheet)).withColumn("in_block", F.row_number().over(W.partitionBy("workbook", "sheet", "block_no").orderBy("row_no")))
    body = r.where("block_no > 0 and in_block > 2")
    block = W.partitionBy("workbook", "sheet", "block_no").orderBy("row_no").rowsBetween(W.unboundedPreceding, 0)
    return body.select(
        "workbook", "sheet", "block_no", "row_no",
        F.last(F.col("cells")[2], True).over(block).alias("skill"), F.col("cells")[2].isNull().alias("inherited_skill"),
        F.last(F.col("cells")[3], True).over(block).alias("dimension"), F.col("cells")[3].isNull().alias("inherited_dimension"),
        F.map_filter("cells", lambda k, v: k > 3).alias("levels"),
    )


@F.pandas_udf(T.StringType())
def docx_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Paragraphs of a DOCX file joined by line ends; null if it can't be read."""

    def text(data: bytes) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        lines = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")).strip() for p in root.iter(f"{_WORD}p"))
        return "\n".join(line for line in lines if line)

    for s in batches:
        yield s.map(lambda x: text(bytes(x)), na_action="ignore")


def separator(text: str) -> str:
    """The sign among comma, semicolon and tab that parts the most lines of the whole text; the first of equals."""
    lines = text.splitlines()
    return max(",;\t", key=lambda sign: sum(sign in line for line in lines))


@F.pandas_udf(T.StringType())
def csv_text(texts: pd.Series) -> pd.Series:
    """Records of a delimited text as paragraphs ``head: a | b``, without empty fields and records; null for null."""
    out = []
    for raw in texts:
        if not isinstance(raw, str):
            out.append(None)
            continue
        paragraphs = []
        for record in csv.reader(io.StringIO(raw, newline=""), delimiter=separator(raw)):
            head, *more = list(filter(None, map(str.strip, record))) or [""]
            paragraphs.append(": ".join(filter(None, (head, " | ".join(more)))))
        out.append("\n\n".join(filter(None, paragraphs)))
    return pd.Series(out, dtype=object)


def brief_texts(found: DataFrame) -> DataFrame:
    """(name, text) of .txt, .md, .csv and .docx files; other kinds have a null text."""
    ext = F.lower(F.substring_index("name", ".", -1))
    plain = decode_text(F.col("content"))
    text = F.when(ext.isin("txt", "md"), plain).when(ext == "csv", csv_text(F.when(ext == "csv", plain))).when(ext == "docx", docx_text(F.when(ext == "docx", F.col("content"))))
    return found.select("name", text.alias("text"))


@F.pandas_udf(T.StringType())
def _entities(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore").astype(object).where(texts.notna(), None)


def _untagged(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "(?s)<[^>]+>", " "), SPACES, " "))


def html_text(x: Column) -> Column:
    """Text of a piece of HTML: all entities decoded, then tags away, blanks collapsed."""
    return _untagged(_entities(x))


def html_hierarchy(pages: DataFrame, group: str = "h2", item: str = "h3", leaf: str = "li") -> DataFrame:
    """(page_id, group_no, group_name, item_no, item_name, leaves) of pages (page_id, html) with headed sections."""
    g = pages.select("page_id", F.posexplode(F.slice(F.split("html", f"(?i)<{group}[^>]*>"), 2, (1 << 31) - 1)).alias("group_no", "g"))
    g = g.select("page_id", "group_no", html_text(F.split("g", f"(?i)</{group}>")[0]).alias("group_name"), "g")
    i = g.select("page_id", "group_no", "group_name", F.posexplode(F.slice(F.split("g", f"(?i)<{item}[^>]*>"), 2, (1 << 31) - 1)).alias("item_no", "i"))
    found = F.array_join(F.regexp_extract_all("i", F.lit(f"(?is)<{leaf}[^>]*>(.*?)</{leaf}>"), F.lit(1)), "\0")  # decoded together
    leaves = F.transform(F.split(_entities(found), "\0"), _untagged)
    return i.select("page_id", "group_no", "group_name", "item_no", html_text(F.split("i", f"(?i)</{item}>")[0]).alias("item_name"), F.filter(leaves, lambda x: x != "").alias("leaves"))


def usage_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def csv_bytes(rows: DataFrame, columns: list[tuple[str, str]], section: str = "") -> bytes:
    """A report for a spreadsheet: byte order mark, a line of the section's name, a line of titles, then the rows.

    For a report small enough to be looked at; larger results are written with ``df.write.csv``.
    """
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow([section, *[""] * (len(columns) - 1)])
    w.writerow([title for _, title in columns])
    for r in rows.select(*[c for c, _ in columns]).toLocalIterator():
        w.writerow(["" if v is None else v for v in r])
    return b"\xef\xbb\xbf" + out.getvalue().encode()
