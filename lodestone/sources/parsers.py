"""Parsers: documents to ordered elements.

An element is (doc_id, ord, kind, text, level, headers, rows, page, section), kind one of
text, heading, table, image, page_break. Line-based formats are parsed with
DataFrame functions; zipped office formats by an Arrow function over binaryFile
rows with the standard library, within limits.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import clean_html
from lodestone.session import kept

ELEMENT = "doc_id long, ord int, kind string, text string, level int, headers array<string>, rows array<array<string>>, page int, section string"
# What a source may hold.
MAX_FILE_BYTES, MAX_PAGES, MAX_UNZIPPED, MAX_RATIO, MAX_ENTRIES = 50 * 1024 * 1024, 500, 100 * 1024 * 1024, 100, 10_000
ROW_GROUP = 50
OCR_BELOW = 30

# MIME types by parser, in the order in which parsers are asked.
MIME = (
    ("pdf", ("application/pdf",)),
    ("docx", ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword")),
    ("text", ("text/plain", "text/markdown", "text/x-markdown")),
    ("html", ("text/html", "application/xhtml+xml")),
    ("tabular", ("text/csv", "text/tab-separated-values", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet")),
    ("image", ("image/jpeg", "image/png", "image/webp")),
)


def parser_for(mime: Column) -> Column:
    """The first parser that takes a MIME type, null for none."""
    out = F.lit(None).cast("string")
    for name, types in reversed(MIME):
        out = F.when(F.lower(mime).isin(*types), name).otherwise(out)
    return out


def within_limits(docs: DataFrame, size: str = "size_bytes") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason)."""
    reason = F.when(F.col(size) > MAX_FILE_BYTES, "file too large")
    judged = docs.withColumn("reject_reason", reason)
    return judged.where("reject_reason is null").drop("reject_reason"), judged.where("reject_reason is not null")


def unsafe_entry(name: Column) -> Column:
    """Whether a zip entry would leave its folder."""
    return name.rlike(r"(^|[/\\])\.\.([/\\]|$)") | name.startswith("/")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Elements of (doc_id, line_no, kind, text, level, block) rows; see parse_text and parse_html.

    Rows of equal block are one paragraph or one table. A paragraph's lines are
    joined by a space; a table's first row is its header. The section is the
    last heading before.
    """
    by_doc = W.partitionBy("doc_id").orderBy("line_no")
    cells = F.transform(F.split(F.regexp_replace("text", r"^\||\|$", ""), r"\|"), _trim)
    grouped = lines.groupBy("doc_id", "block", "kind").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", F.col("text").alias("t"), F.when(F.col("kind") == "table", cells).alias("cells")))).alias("l"), F.max("level").alias("level"))
    text = F.when(F.col("kind") != "table", F.array_join(F.transform("l", lambda x: x["t"]), " "))
    table = F.transform("l", lambda x: x["cells"])
    section = F.last(F.when(F.col("kind") == "heading", text), ignorenulls=True).over(by_doc.rowsBetween(W.unboundedPreceding, W.currentRow))
    out = grouped.withColumn("section", section).withColumn("ord", (F.row_number().over(by_doc) - 1).cast("int"))
    is_table = F.col("kind") == "table"
    return out.select(
        "doc_id", "ord", "kind", text.alias("text"), "level",
        F.when(is_table, F.element_at(table, 1)).alias("headers"),
        F.when(is_table, F.slice(table, 2, F.greatest(F.lit(1), F.size(table)))).alias("rows"),
        F.lit(None).cast("int").alias("page"), "section",
    )


def classify(line: Column) -> Column:
    """Kind of a trimmed line: rule (dropped), table, heading, blank or text."""
    return (
        F.when(line.startswith("|") & line.contains("---"), "rule")
        .when(line.startswith("|") & line.endswith("|") & (F.length(line) > 1), "table")
        .when(line.rlike(r"^#{1,6}\s+.+$"), "heading")
        .when(line == "", "blank")
        .otherwise("text")
    )


def blocks(lines: DataFrame) -> DataFrame:
    """Adds block: a number that changes where a paragraph or table ends. lines: (doc_id, line_no, text, kind)."""
    by_doc = W.partitionBy("doc_id").orderBy("line_no")
    kept = lines.where("kind <> 'rule'").withColumn("before", F.lag("kind").over(by_doc))
    # A table row does not end the paragraph around it: text goes on after it.
    kept = kept.withColumn("cut", (F.col("kind").isin("heading", "blank")).cast("int")).withColumn("table_cut", ((F.col("kind") == "table") & F.coalesce(F.col("before") != "table", F.lit(True))).cast("int"))
    run = by_doc.rowsBetween(W.unboundedPreceding, W.currentRow)
    number = F.when(F.col("kind") == "table", -F.sum("table_cut").over(run)).when(F.col("kind") == "heading", F.col("line_no") * 2 + 1).otherwise(F.sum("cut").over(run) * 2)
    return kept.withColumn("block", F.concat_ws(":", "kind", number.cast("string"))).where("kind <> 'blank'")


def parse_text(docs: DataFrame) -> DataFrame:
    """Plain text and Markdown (doc_id, text): headings, tables between bars, paragraphs. Empty texts give nothing."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line_no", "raw"))
    lines = lines.select("doc_id", "line_no", _trim(F.col("raw")).alias("line"))
    marked = lines.withColumn("kind", classify(F.col("line")))
    heading = F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 2)
    marked = marked.select("doc_id", "line_no", "kind", F.when(F.col("kind") == "heading", F.trim(heading)).otherwise(F.col("line")).alias("text"), F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", r"^(#{1,6})", 1))).alias("level"))
    return parse_lines(blocks(marked))


def html_lines(html: Column, mode: str = "block") -> Column:
    """array<string> of a page's lines. mode "block" drops script and style elements and breaks at block tags, so pages
    on one line keep their text; mode "line" takes the source's lines and drops those with a script or style tag."""
    if mode == "block":
        t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\s*\1\s*>|<!--.*?-->|<head\b.*?</\s*head\s*>", " ")
        t = F.regexp_replace(t, r"[\r\n]+", " ")
        t = F.regexp_replace(t, r"(?i)<h([1-6])\b[^>]*>", "\n<h$1>")
        t = F.regexp_replace(t, r"(?i)</\s*h[1-6]\s*>", "</h>\n\n")
        t = F.regexp_replace(t, r"(?i)</?\s*(p|div|li|ul|ol|table|section|article|nav|header|footer|main|aside|blockquote|pre|body|html)\b[^>]*>", "\n\n")
        t = F.regexp_replace(t, r"(?i)<\s*br\s*/?>", "\n")
        return F.split(t, "\n")
    return F.filter(F.split(html, r"\r\n|\n|\r"), lambda x: ~x.rlike(r"(?i)<\s*/?\s*(script|style)\b"))


def parse_html(pages: DataFrame, doc_id: str = "page_id", html: str = "html", mode: str = "block") -> DataFrame:
    """Headings, table rows and texts of (id, html) rows."""
    lines = pages.select(F.col(doc_id).cast("long").alias("doc_id"), F.posexplode(html_lines(F.col(html), mode)).alias("line_no", "raw"))
    if mode == "block":
        lines = lines.select("doc_id", "line_no", F.regexp_replace("raw", r"(?i)(<tr\b)", "\n$1").alias("raw"))
        lines = lines.select("doc_id", "line_no", F.posexplode(F.split("raw", "\n")).alias("part", "raw")).select("doc_id", (F.col("line_no").cast("long") * 2**31 + F.col("part")).alias("line_no"), "raw")
    level = F.regexp_extract("raw", r"(?i)<h([1-6])\b", 1)
    cells = F.transform(F.regexp_extract_all("raw", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</\s*t[dh]\s*>"), F.lit(1)), clean_html)
    text = clean_html(F.col("raw"))
    kind = F.when(F.size(cells) > 0, "table").when(level != "", "heading").when(text == "", "blank").otherwise("text")
    marked = lines.select("doc_id", "line_no", kind.alias("kind"), F.when(F.size(cells) > 0, F.concat(F.lit("|"), F.array_join(cells, "|"), F.lit("|"))).otherwise(text).alias("text"), level.try_cast("int").alias("level"))
    return parse_lines(blocks(marked))


def split_csv_line(line: Column, delimiter: str = ",") -> Column:
    """Cells of a line: a quote only toggles quoting and is dropped, cells are trimmed. A fold over the characters."""
    start = F.struct(F.array().cast("array<string>").alias("cells"), F.lit("").alias("cell"), F.lit(False).alias("quoted"))

    def step(s: Column, c: Column) -> Column:
        return (
            F.when(c == '"', F.struct(s["cells"].alias("cells"), s["cell"].alias("cell"), (~s["quoted"]).alias("quoted")))
            .when((c == delimiter) & ~s["quoted"], F.struct(F.concat(s["cells"], F.array(F.trim(s["cell"]))).alias("cells"), F.lit("").alias("cell"), s["quoted"].alias("quoted")))
            .otherwise(F.struct(s["cells"].alias("cells"), F.concat(s["cell"], c).alias("cell"), s["quoted"].alias("quoted")))
        )

    return F.aggregate(F.filter(F.split(line, ""), lambda c: c != ""), start, step, lambda s: F.concat(s["cells"], F.array(F.trim(s["cell"]))))


def parse_csv(docs: DataFrame, delimiter: str = ",", group: int = ROW_GROUP) -> DataFrame:
    """Tables of `group` rows of (doc_id, text); the first line that is not blank is every table's header."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.filter(F.split("text", r"\r\n|\n|\r"), lambda x: _trim(x) != "")).alias("n", "line"))
    cells = lines.select("doc_id", "n", split_csv_line(F.col("line"), delimiter).alias("cells"))
    head = cells.where("n = 0").select("doc_id", F.col("cells").alias("headers"))
    body = cells.where("n > 0").withColumn("ord", F.floor((F.col("n") - 1) / group).cast("int"))
    tables = body.groupBy("doc_id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "cells"))), lambda x: x["cells"]).alias("rows"))
    null = F.lit(None)
    return tables.join(head, "doc_id").select("doc_id", "ord", F.lit("table").alias("kind"), null.cast("string").alias("text"), null.cast("int").alias("level"), "headers", "rows", null.cast("int").alias("page"), null.cast("string").alias("section"))


def row_groups(rows: DataFrame, order: list[str], group: int = ROW_GROUP) -> DataFrame:
    """Spark's own CSV reader's rows, dealt to tables of `group` rows: (ord, n_rows). Rows are sorted by ranges, and a row's
    number is its place in its range after the rows of the ranges before, so no task sees the whole table."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(rows.select(*order).repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    ahead = counts.select("__range", F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    place = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    numbered = dealt.withColumn("__place", place).join(F.broadcast(ahead), "__range")  # a row of two numbers for each range
    return numbered.groupBy(F.floor((F.col("__ahead") + F.col("__place") - 1) / group).cast("int").alias("ord")).agg(F.count("*").alias("n_rows"))


class LimitError(ValueError):
    """A source breaks a limit."""


def read_zip(data: bytes, names: Callable[[str], bool], limit: int = MAX_UNZIPPED) -> dict[str, bytes]:
    """The wanted entries of an archive; LimitError for unsafe names, too many entries or too many bytes in all."""
    out, total = {}, 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        entries = z.infolist()
        if len(entries) > MAX_ENTRIES:
            raise LimitError("too many entries")
        for e in entries:
            if re.search(r"(^|[/\\])\.\.([/\\]|$)", e.filename) or e.filename.startswith("/"):
                raise LimitError("entry leaves its folder")
            if not names(e.filename):
                continue
            with z.open(e) as f:
                body = f.read(limit - total + 1)
            total += len(body)
            if total > limit or (e.compress_size and len(body) > MAX_RATIO * e.compress_size and len(body) > 1_000_000):
                raise LimitError("archive unfolds too far")
            out[e.filename] = body
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attr(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def docx_elements(data: bytes) -> list[dict]:
    """Headings, paragraphs and tables of word/document.xml, in order."""
    parts = read_zip(data, lambda n: n == "word/document.xml")
    if not parts:
        return []
    body = next((x for x in ElementTree.fromstring(parts["word/document.xml"]).iter() if _local(x.tag) == "body"), None)
    out: list[dict] = []
    said = lambda p: "".join(t.text or "" for t in p.iter() if _local(t.tag) == "t").strip()
    for node in body if body is not None else ():
        if _local(node.tag) == "p":
            style = next((_attr(x, "val") or "" for x in node.iter() if _local(x.tag) == "pStyle"), "")
            text = said(node)
            if text and style.startswith("Heading"):
                out.append({"kind": "heading", "text": text, "level": int(re.sub(r"\D", "", style) or 1)})
            elif text:
                out.append({"kind": "text", "text": text})
        elif _local(node.tag) == "tbl":
            rows = [[said(p) for p in r.iter() if _local(p.tag) == "p"] for r in node.iter() if _local(r.tag) == "tr"]
            rows = [r for r in rows if r]
            if rows:
                out.append({"kind": "table", "headers": rows[0], "rows": rows[1:]})
    return out


def xlsx_elements(data: bytes, group: int = ROW_GROUP) -> list[dict]:
    """Tables of `group` rows of each sheet; the first row is the header; empty cells are left out."""
    parts = read_zip(data, lambda n: n == "xl/sharedStrings.xml" or re.fullmatch(r"xl/worksheets/sheet\d*\.xml", n) is not None)
    shared = [x.text or "" for x in ElementTree.fromstring(parts.pop("xl/sharedStrings.xml")).iter() if _local(x.tag) == "t"] if "xl/sharedStrings.xml" in parts else []
    out: list[dict] = []
    for name in sorted(parts):
        rows = []
        for row in (x for x in ElementTree.fromstring(parts[name]).iter() if _local(x.tag) == "row"):
            cells = []
            for c in (x for x in row if _local(x.tag) == "c"):
                v = next((x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t")), None)
                if v is not None:
                    cells.append(shared[int(v)] if _attr(c, "t") == "s" and int(v) < len(shared) else v)
            if cells:
                rows.append(cells)
        for at in range(1, len(rows), group):
            out.append({"kind": "table", "headers": rows[0], "rows": rows[at : at + group]})
    return out


def parse_binary(files: DataFrame, parse: Callable[[bytes], list[dict]]) -> tuple[DataFrame, DataFrame]:
    """(elements, errors) of files (doc_id, content) by a Python parser: docx_elements, xlsx_elements or one of your own.
    A file that breaks a limit or cannot be read gives one error row and no elements."""
    schema = ELEMENT + ", error string"
    names = [x.split(" ", 1)[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, data in zip(b["doc_id"], b["content"], strict=True):
                try:
                    if len(data) > MAX_FILE_BYTES:
                        raise LimitError("file too large")
                    found, section = parse(bytes(data)), None
                except Exception as e:  # noqa: BLE001 - any broken file becomes an error row
                    rows.append({"doc_id": doc_id, "error": f"{type(e).__name__}: {e}"[:200]})
                    continue
                for n, x in enumerate(found):
                    section = x["text"] if x["kind"] == "heading" else section
                    rows.append({"doc_id": doc_id, "ord": n, "section": section} | x)
            out = pd.DataFrame(rows, columns=names).astype(object)
            yield out.where(out.notna(), None).astype({"ord": "Int32", "level": "Int32", "page": "Int32"})

    out = files.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInPandas(run, schema)
    return out.where("error is null").drop("error"), out.where("error is not null").select("doc_id", "error")


def pdf_pages(pages: DataFrame, ocr: Callable[[Column], Column] | None = None) -> DataFrame:
    """Elements of pages that a PDF reader has extracted (doc_id, page, text, image): a text and a page break for each;
    pages with fewer than 30 characters take the OCR's text if there is an OCR. Reading PDFs itself is a plug-in."""
    text = F.when(F.length(F.trim("text")) < OCR_BELOW, ocr(F.col("image"))).otherwise(F.col("text")) if ocr else F.col("text")
    parts = F.array(F.struct(F.lit("text").alias("kind"), text.alias("text")), F.struct(F.lit("page_break").alias("kind"), F.lit(None).cast("string").alias("text")))
    rows = pages.where(F.col("page") <= MAX_PAGES).select(F.col("doc_id").cast("long").alias("doc_id"), "page", F.posexplode(parts).alias("n", "p"))
    null = F.lit(None)
    return rows.select("doc_id", ((F.col("page") - 1) * 2 + F.col("n")).cast("int").alias("ord"), "p.kind", "p.text", null.cast("int").alias("level"), null.cast("array<string>").alias("headers"), null.cast("array<array<string>>").alias("rows"), F.col("page").cast("int").alias("page"), null.cast("string").alias("section"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(doc_id, path, size_bytes, content) of the files below a folder; doc_id is a hash of the path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return f.select(F.xxhash64("path").alias("doc_id"), "path", F.col("length").alias("size_bytes"), "content")


def image_elements(files: DataFrame, ocr: Callable[[Column], Column]) -> DataFrame:
    """One text for each image (doc_id, content). ocr: content column to text column, a plug-in."""
    null = F.lit(None)
    return files.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("ord"), F.lit("text").alias("kind"), ocr(F.col("content")).alias("text"), null.cast("int").alias("level"),
        null.cast("array<string>").alias("headers"), null.cast("array<array<string>>").alias("rows"), null.cast("int").alias("page"), null.cast("string").alias("section"),
    )


def parse_all(files: DataFrame, ocr: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(elements, errors) of files (doc_id, mime_type, size_bytes, content): each goes to the first parser that takes its
    type; files over the limits, of unknown types or broken give an error row. PDFs need a reader in front (see pdf_pages)."""
    good, big = within_limits(files)
    typed = good.withColumn("parser", parser_for(F.col("mime_type")))
    of = lambda *names: typed.where(F.col("parser").isin(*names))
    text = lambda df: df.select("doc_id", F.col("content").cast("string").alias("text"))
    sheets = F.col("mime_type").contains("spreadsheet")
    elements = parse_text(text(of("text")))
    elements = elements.unionByName(parse_html(text(of("html")), "doc_id", "text"))
    tables = of("tabular").where(~sheets)
    for tab, delimiter in ((False, ","), (True, "\t")):
        elements = elements.unionByName(parse_csv(text(tables.where(F.col("mime_type").contains("tab-separated") == tab)), delimiter))
    errors = big.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("reject_reason").alias("error"))
    for rows, parse in ((of("docx"), docx_elements), (of("tabular").where(sheets), xlsx_elements)):
        found, bad = parse_binary(rows, parse)
        elements, errors = elements.unionByName(found), errors.unionByName(bad)
    taken = ["text", "html", "tabular", "docx"]
    if ocr:
        elements, taken = elements.unionByName(image_elements(of("image"), ocr)), [*taken, "image"]
    rest = typed.where(~F.coalesce(F.col("parser").isin(*taken), F.lit(False)))
    return elements, errors.unionByName(rest.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("NO_SUPPORTED_PARSER").alias("error")))
