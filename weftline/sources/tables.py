"""Loaders with one interface, JSON lines, and the driver's tables."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "path string, format string, title string, text string"
ALPACA = "instruction string, input string, output string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder; timestamps without a zone become UTC instants."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """Plain text files, one row each."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select("path", F.lit("txt").alias("format"), F.lit(None).cast("string").alias("title"), "text")


def load_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files; the title is the first heading."""
    rows = load_text(spark, path)
    title = F.regexp_extract("text", r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$", 1)
    return rows.select("path", F.lit("md").alias("format"), F.nullif(title, F.lit("")).alias("title"), "text")


def load_markdown_sections(spark: SparkSession, path: str) -> DataFrame:
    """path, section_no, level, heading, text: Markdown files cut at their headings; what stands before the first is section 0 without one."""
    body = F.split(F.concat(F.lit("\n"), "text"), r"\n(?=#{1,6}[ \t])")
    each = load_text(spark, path).select("path", F.posexplode(body).alias("section_no", "part"))
    head = r"^(#{1,6})[ \t]+([^\n]*?)[ \t]*#*[ \t]*(?:\n|$)"
    has = F.col("part").rlike(head)
    return each.select(
        "path", "section_no", F.when(has, F.length(F.regexp_extract("part", head, 1))).alias("level"), F.when(has, F.regexp_extract("part", head, 2)).alias("heading"), F.trim(F.regexp_replace("part", head, "")).alias("text")
    ).where("heading is not null or text != ''")


def load_word(spark: SparkSession, path: str) -> DataFrame:
    """Word files: paragraphs of the document part, joined by newlines; a file that can't be read has a null text."""

    def parse(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "format": "docx", "title": None, "text": [_word_text(bytes(c)) for c in pdf["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, DOCUMENT)


def _word_text(content: bytes) -> str | None:
    name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    return "\n".join("".join(t.text or "" for t in p.iter(f"{name}t")) for p in root.iter(f"{name}p"))


def load_pdf(spark: SparkSession, path: str) -> DataFrame:
    """PDF files with uncompressed or flate text streams: the strings shown, in order; others have an empty text."""

    def parse(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "format": "pdf", "title": None, "text": [_pdf_text(bytes(c)) for c in pdf["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, DOCUMENT)


def _pdf_text(content: bytes) -> str:
    import zlib

    out = []
    for body in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        for shown in re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|')|\[((?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ", body, re.S):
            parts = [shown[0]] if shown[0] else re.findall(rb"\(((?:\\.|[^\\()])*)\)", shown[1], re.S)
            out.append(b"".join(re.sub(rb"\\(.)", rb"\1", p, flags=re.S) for p in parts).decode("latin-1"))
    return "\n".join(out)


LOADERS = {"txt": load_text, "md": load_markdown, "docx": load_word, "pdf": load_pdf}


def load_documents(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Documents of several formats ({format: path or glob}) in one schema."""
    out = None
    for kind, path in sorted(paths.items()):
        part = LOADERS[kind](spark, path)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], DOCUMENT)


def read_alpaca(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of instruction, input and output; malformed lines go to _corrupt_record."""
    return spark.read.schema(f"{ALPACA}, _corrupt_record string").json(path)


def write_alpaca(df: DataFrame, path: str) -> None:
    df.select("instruction", "input", "output").write.mode("overwrite").json(path)


CASES = "case_id string, query string, expected string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set as JSON lines of case_id, query and expected; malformed lines go to _corrupt_record."""
    return spark.read.schema(f"{CASES}, _corrupt_record string").json(path)


def write_report(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """An evaluation or cost report as parquet, json, csv (with a header), or text (the column line, in the order of line_no)."""
    if kind == "text":
        df.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)  # a report is small
    else:
        df.write.mode("overwrite").options(**({"header": "true"} if kind == "csv" else {})).format(kind).save(path)


def append_log(df: DataFrame, path: str) -> None:
    """Add audit, access or quality rows to a log."""
    df.write.mode("append").parquet(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with their sizes; bytes stay unread unless they are selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,gif,webp}").load(path)


def resource(table_: DataFrame, uri: str) -> DataFrame:
    """The row of a resource by its URI, with the parts of the URI."""
    return table_.where(F.col("uri") == uri).withColumns({"scheme": F.parse_url("uri", F.lit("PROTOCOL")), "host": F.parse_url("uri", F.lit("HOST")), "path": F.parse_url("uri", F.lit("PATH"))})
