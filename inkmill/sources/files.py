"""Files as tables (digests, kinds by content, the text of text files and of word-processor documents), and tables as files."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MOST_BYTES = 50 * 1024 * 1024
TEXT_EXTENSIONS = [".txt", ".md", ".csv", ".json", ".log", ".xml", ".html", ".py", ".sql", ".yaml", ".yml", ".tsv"]
# First bytes of file kinds, in hex.
MAGIC = [("255044462D", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("424D", "image/bmp"), ("504B0304", "application/zip")]
ENCODINGS = ("utf-8-sig", "utf-16", "cp1256", "latin-1")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, extension, size, content, digest and mime of every file below path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    return rows.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"), F.col("length").alias("size"), "content", F.sha2("content", 256).alias("digest"), sniff(F.col("content")).alias("mime"))


def sniff(content: Column) -> Column:
    """The kind by first bytes, whatever the name says; null if unknown."""
    head, chain = F.hex(F.substring(content, 1, 16)), None
    for magic, mime in MAGIC:
        chain = F.when(head.startswith(magic), mime) if chain is None else chain.when(head.startswith(magic), mime)
    return chain.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")


def handler(mime: Column, extension: Column, size: Column) -> Column:
    """Who reads an attachment: pdf, docx, text or image; too_large or unsupported if none may."""
    return (
        F.when(size > MOST_BYTES, "too_large")
        .when(mime == "application/pdf", "pdf")
        .when((mime == "application/zip") & (extension == ".docx"), "docx")
        .when(extension.isin(TEXT_EXTENSIONS), "text")
        .when(mime.startswith("image/"), "image")
        .otherwise("unsupported")
    )


def decoded(data: bytes | None) -> str | None:
    """Text by the first encoding that fits; null for binary data (a zero byte early on)."""
    if data is None or b"\x00" in data[:4096]:
        return None
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return None


def docx_text(data: bytes | None) -> str | None:
    """Paragraphs that are not blank, then table rows with cells parted by bars; null if it is no such file."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD}t"))
    lines = [x for x in (said(p) for p in body.findall(f"{WORD}p")) if x.strip()]
    for row in body.iter(f"{WORD}tr"):
        lines.append(" | ".join(re.sub(r"\s+", " ", said(c)).strip() for c in row.findall(f"{WORD}tc")))
    return "\n".join(lines)


@F.pandas_udf(StringType())
def decode_text(content: pd.Series) -> pd.Series:
    return content.map(decoded)


@F.pandas_udf(StringType())
def decode_docx(content: pd.Series) -> pd.Series:
    return content.map(docx_text)


def attachment_text(files: DataFrame) -> DataFrame:
    """files with who reads them and, for text and word-processor files, the text."""
    kind = handler(F.col("mime"), F.col("extension"), F.col("size"))
    rows = files.withColumn("handler", kind)
    text = rows.filter("handler = 'text'").withColumn("text", decode_text("content"))
    docx = rows.filter("handler = 'docx'").withColumn("text", decode_docx("content"))
    other = rows.filter("handler NOT IN ('text', 'docx')").withColumn("text", F.lit(None).cast("string"))
    return text.unionByName(docx).unionByName(other)


def page_folders(spark: SparkSession, path: str) -> DataFrame:
    """<stem>/<stem>.md below path: stem and the whole text."""
    rows = spark.read.text(f"{path}/*/*.md", wholetext=True).withColumn("path", F.input_file_name())
    stem = F.regexp_extract("path", r"([^/]+)/([^/]+)\.md$", 1)
    return rows.select(stem.alias("stem"), F.col("value").alias("markdown"), "path").filter(F.regexp_extract("path", r"([^/]+)\.md$", 1) == F.col("stem")).drop("path")


def page_metadata(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """page_folders() with the metadata beside each text, <stem>/<stem>_metadata.json: the JSON object ("{}" without one that can be read), or columns of a schema in its place."""
    rows = spark.read.option("pathGlobFilter", "*_metadata.json").text(f"{path}/*", wholetext=True).withColumn("path", F.input_file_name())
    stem = F.regexp_extract("path", r"([^/]+)/([^/]+)_metadata\.json$", 1)
    rows = rows.filter(F.regexp_extract("path", r"([^/]+)_metadata\.json$", 1) == stem).select(stem.alias("stem"), F.trim(F.regexp_replace("value", "^\ufeff", "")).alias("json"))
    rows = rows.filter(F.col("json").startswith("{") & F.try_parse_json("json").isNotNull())
    joined = page_folders(spark, path).join(rows, "stem", "left").withColumn("json", F.coalesce("json", F.lit("{}")))
    return joined.withColumn("metadata", F.from_json("json", schema)).select("stem", "markdown", "metadata.*") if schema else joined.withColumnRenamed("json", "metadata")


def write_files(files: DataFrame, root: str, folder: str = "folder", name: str = "name", content: str = "content") -> DataFrame:
    """Writes each row's bytes to <root>/<folder>/<name>, in any file system that Arrow can open; a table of folder, name, path and size.

    Work is done as rows are asked for, by the tasks that hold them. A file is written under a name of its own and then
    moved, so that a task that runs twice leaves one whole file; of rows with one folder and name any stays. Rows with a
    null in any of the three, or with a name or folder that would leave its place, are left out.
    """

    def plain(c: str) -> Column:
        return (F.col(c).cast("string") != "") & ~F.col(c).cast("string").rlike(r"[/\\]") & ~F.col(c).cast("string").isin(".", "..")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for batch in batches:
            paths = []
            for at, called, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                place, part = f"{base}/{at}/{called}", f"{base}/{at}/.{uuid.uuid4().hex}"
                system.create_dir(f"{base}/{at}", recursive=True)
                with system.open_output_stream(part) as out:
                    out.write(data)
                system.move(part, place)
                paths.append(f"{root}/{at}/{called}")
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(paths, pa.string()), pa.array([len(x) for x in batch.column(2).to_pylist()], pa.int64())], names=["folder", "name", "path", "size"])

    rows = files.filter(F.col(content).isNotNull() & plain(folder) & plain(name))
    rows = rows.select(F.col(folder).cast("string").alias("folder"), F.col(name).alias("name"), F.col(content).alias("content"))
    return rows.mapInArrow(write, "folder string, name string, path string, size long")
