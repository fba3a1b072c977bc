"""Reading folders of files: listing, decoding, subtitles, books, and user extractors."""

from __future__ import annotations

import io
import posixpath
import zipfile
from dataclasses import dataclass
from typing import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge import fixed_values as fixed
from corpusforge.functions.formats import file_ext
from corpusforge.functions.text import has_length, html_to_text, normalize_newlines, srt_to_text, vtt_to_text
from corpusforge.operators.pages import assemble_document
from corpusforge.operators.quality import admission, page_filter


def scan_files(
    spark: SparkSession,
    folder: str,
    extensions: list[str] | None = None,
    recursive: bool = True,
    pattern: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Files of a folder (or one file) as `path, mtime, length, content`.

    `content` is read only by queries that select it. Extensions ignore case. `max_files` keeps
    the first paths in order.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(folder).withColumnRenamed("modificationTime", "mtime")
    supported = list(fixed.PROCESSOR_BY_EXT) if extensions is None else [e.lower() for e in extensions]
    files = files.filter(file_ext(F.col("path")).isin(supported)) if not pattern or extensions else files
    if max_files is None:
        return files
    first = files.select("path").orderBy("path").limit(max_files)
    return files.join(first, "path", "left_semi")


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1; line ends become `\\n`."""
    utf8 = content.cast("string")
    return normalize_newlines(F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode(content, "ISO-8859-1")))


def read_text(files: DataFrame) -> DataFrame:
    """Text of .txt, .srt and .vtt files."""
    raw = decode_text(F.col("content"))
    ext = file_ext(F.col("path"))
    text = F.when(ext == ".srt", srt_to_text(raw)).when(ext == ".vtt", vtt_to_text(raw)).otherwise(raw)
    return files.filter(ext.isin(".txt", ".srt", ".vtt")).select("path", "mtime", "length", text.alias("text"))


def book_members(file) -> Iterator[dict]:
    """Chapters of an EPUB in reading-list order of its package file, and its images, one at a time.

    `file` is bytes or a file that can seek: of an open file only the directory and the members asked for are read.
    """
    container = "{urn:oasis:names:tc:opendocument:xmlns:container}rootfile"
    package = "{http://www.idpf.org/2007/opf}"
    with zipfile.ZipFile(io.BytesIO(file) if isinstance(file, bytes) else file) as book:
        root = ElementTree.fromstring(book.read("META-INF/container.xml")).find(f".//{container}").get("full-path")
        counts: dict[str, int] = {}
        for item in ElementTree.fromstring(book.read(root)).findall(f".//{package}manifest/{package}item"):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(root), item.get("href")))
            kind = item.get("media-type", "")
            if kind == "application/xhtml+xml":
                counts["chapter"] = counts.get("chapter", 0) + 1
                yield {"kind": "chapter", "member_no": counts["chapter"], "name": name, "html": book.read(name).decode("utf-8", "replace")}
            elif kind.startswith("image/"):
                counts["image"] = counts.get("image", 0) + 1
                yield {"kind": "image", "member_no": counts["image"], "name": name, "size_bytes": book.getinfo(name).file_size}


BOOK_SCHEMA = "path string, kind string, member_no int, name string, html string, size_bytes long, error string"
_BOOK_ARROW = pa.schema(
    [("path", pa.string()), ("kind", pa.string()), ("member_no", pa.int32()), ("name", pa.string()),
     ("html", pa.string()), ("size_bytes", pa.int64()), ("error", pa.string())]
)


def read_epub(files: DataFrame) -> DataFrame:
    """Members of EPUB files: chapters numbered from 1 with their markup, images with their size.

    A file that cannot be opened gives one row with `error`.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows = [{"path": path, **member} for member in book_members(content)]
                except Exception as exc:  # a broken file must not end the task
                    rows = [{"path": path, "kind": "error", "error": str(exc)}]
                yield pa.RecordBatch.from_pylist(rows, schema=_BOOK_ARROW)

    books = files.filter(file_ext(F.col("path")) == ".epub").select("path", "content")
    return books.mapInArrow(unpack, BOOK_SCHEMA)


def epub_text(members: DataFrame, start: int = 1, end: int | None = None, skip: list[int] | None = None, min_length: int = 0) -> DataFrame:
    """Chapters of the wanted range to one text per book, each under its chapter line."""
    chapters = members.filter("kind = 'chapter'").select("path", F.col("member_no").alias("page_num"), html_to_text(F.col("html")).alias("text"))
    wanted = page_filter(chapters, start, end, skip).filter(has_length(F.col("text"), min_length))
    return assemble_document(wanted, headers="=== Chapter %d ===")


def epub_info(members: DataFrame) -> DataFrame:
    chapter = F.col("kind") == "chapter"
    size = F.coalesce(F.sum(F.when(chapter, F.octet_length("html"))), F.lit(0))
    return members.groupBy("path").agg(
        F.count_if(chapter).alias("chapter_count"),
        F.count_if(F.col("kind") == "image").alias("image_count"),
        size.alias("total_content_size"),
        F.floor(size / fixed.BYTES_PER_PAGE).alias("estimated_pages"),
    )


@dataclass(frozen=True)
class Extractor:
    """A user's reader for some file types: bytes of one file to its text and image records."""

    extensions: tuple[str, ...]
    extract: Callable[[str, bytes], dict]


EXTRACTED = "path string, text string, images string, status string, error string"


def extract_batch(files: DataFrame, extractors: list[Extractor], max_bytes: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    """Run the extractor of each file's type; failures become rows with `status` and `error`.

    `images` is the JSON text of the extractor's image records.
    """
    by_ext = {ext.lower(): e.extract for e in extractors for ext in e.extensions}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                ext = posixpath.splitext(path)[1].lower()
                try:
                    found = by_ext[ext](path, bytes(content))
                    images = json.dumps(found.get("images", []), ensure_ascii=False)
                    rows.append((path, found.get("text", ""), images, "ok", None))
                except Exception as exc:  # one bad file must not end the task
                    rows.append((path, "", "[]", "error", str(exc)))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in EXTRACTED.split(", ")])

    status = admission(F.col("path"), F.col("length"), max_bytes, list(by_ext))
    # Refused files are reported without reading their bytes.
    refused = files.select("path", status.alias("status")).filter("status <> 'ok'").select(
        "path", F.lit("").alias("text"), F.lit("[]").alias("images"), "status", F.lit(None).cast("string").alias("error")
    )
    taken = files.filter(status == "ok").select("path", "content").mapInPandas(run, EXTRACTED)
    return taken.unionByName(refused)
