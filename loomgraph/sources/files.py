"""Folders of files as text, chunks and ingestion jobs."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.latex import latex_text
from loomgraph.functions.text import chunk_windows, has_text_extension, in_skipped_folder
from loomgraph.operators import jobs
from loomgraph.sources.providers import Reader, read_page, with_retries

LEAST_BYTES = 50
PdfReader = Callable[[bytes], str]


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative, content): files under root outside skipped folders; unreadable ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(root)
    base = "file:" + root.rstrip("/") if "://" not in root and not root.startswith("file:") else root.rstrip("/")
    relative = F.regexp_replace("path", r"^(?:file:/*)?/?", "")
    start = F.length(F.regexp_replace(F.lit(base), r"^(?:file:/*)?/?", "")) + 1
    return files.select("path", F.substring(relative, start, F.lit(10_000)).alias("relative"), "content").where(~in_skipped_folder(F.col("relative")))


def texts(files: DataFrame, pdf: PdfReader | None = None) -> DataFrame:
    """(path, text): files of text extensions that are valid UTF-8, LaTeX sources as plain text, and PDFs if a
    reader is given. A LaTeX source is read together with the other sources and styles of its folder."""
    plain = files.where(has_text_extension(F.col("path")) & F.is_valid_utf8(F.col("content"))).select("path", F.col("content").cast("string").alias("text"))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    tex = files.where(F.lower("path").rlike(r"\.(?:tex|sty)$") & F.is_valid_utf8(F.col("content"))).select("path", folder.alias("folder"), F.col("content").cast("string").alias("text"))
    out = plain.unionByName(tex.groupBy("folder").applyInPandas(_latex_folder, "path string, text string"))
    if pdf is not None:
        out = out.unionByName(files.where(F.lower("path").endswith(".pdf")).select("path", "content").mapInPandas(_pdf_texts(pdf), "path string, text string"))
    return out.where("text IS NOT NULL AND text <> ''")


def _latex_folder(pdf: pd.DataFrame) -> pd.DataFrame:
    files = {p.rsplit("/", 1)[-1]: t for p, t in zip(pdf.path, pdf.text, strict=True)}
    rows = [(p, latex_text(t, files)) for p, t in zip(pdf.path, pdf.text, strict=True) if p.lower().endswith(".tex")]
    return pd.DataFrame(rows, columns=["path", "text"])


def _pdf_texts(reader: PdfReader):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    rows.append((path, reader(content)))
                except Exception:  # a file that cannot be read is skipped
                    continue
            yield pd.DataFrame(rows, columns=["path", "text"])

    return run


def cascade(*readers: Callable[[bytes], str | None]) -> PdfReader:
    """The first reader that gives text: text layer, page pictures, model; an error if none does."""

    def read(content: bytes) -> str:
        for reader in readers:
            if (text := reader(content)) and text.strip():
                return text.strip()
        raise ValueError("no text")

    return read


def by_pages(raster: Callable[[bytes], Iterable[bytes]], read: Callable[[bytes], str | None]) -> Callable[[bytes], str | None]:
    """A reader of page pictures: raster gives the pages of a file in order, read the text of each. A page that
    fails is left out; a file that cannot be rastered has no text."""

    def one(image: bytes) -> str | None:
        try:
            return read(image)
        except Exception:  # the other pages still count
            return None

    def run(content: bytes) -> str | None:
        try:
            return joined_pages([one(image) for image in raster(content)])
        except Exception:
            return None

    return run


def by_model(raster: Callable[[bytes], Iterable[bytes]], reader: Reader, prompt: str, again: str) -> Callable[[bytes], str | None]:
    """Pages read by a model, with one more try after a refusal and retries while it is busy."""
    return by_pages(raster, lambda image: with_retries(lambda: read_page(reader, image, prompt, again)))


_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?P<text>(?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*)\)|<(?P<hex>[0-9A-Fa-f\s]+)>|(?P<gap>-\d{3,})|(?P<line>\b(?:Td|TD|Tm|T\*)|['\"]|\bET\b)", re.S)
_OCTAL = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\n", b"t": b"\t", b"b": b"", b"f": b"", b"\n": b""}


def text_layer(content: bytes) -> str | None:
    """The text that a PDF shows by strings in Latin letters; None for other files and fonts of their own coding.

    Streams are read as they stand or inflated; wide gaps in a line of glyphs are blanks, moves begin a line.
    """
    if not content.startswith(b"%PDF-"):
        return None
    pages = []
    for stream in _STREAM.finditer(content):
        body = stream["body"]
        if b"FlateDecode" in stream["head"]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        out = b""
        for block in re.findall(rb"\bBT\b.*?\bET\b", body, re.S):
            for m in _SHOWN.finditer(block):
                if m["text"] is not None:
                    out += _OCTAL.sub(lambda o: bytes([int(o[1], 8) & 255]) if o[1].isdigit() else _PLAIN.get(o[1], o[1]), m["text"])
                elif m["hex"]:
                    digits = re.sub(rb"\s", b"", m["hex"])
                    out += bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
                elif m["gap"]:
                    out += b" "
                elif not out.endswith(b"\n"):
                    out += b"\n"
        pages.append(out.decode("latin-1"))
    text = joined_pages(pages)
    shown = sum(c.isprintable() or c.isspace() for c in text)
    return text if text and shown >= 0.9 * len(text) else None


def joined_pages(pages: list[str | None]) -> str:
    """Pages in order, failed and empty ones left out, parted by a blank line."""
    return "\n\n".join(p.strip() for p in pages if p and p.strip())


def enough_text(c: Column) -> Column:
    return F.octet_length(F.trim(c)) >= LEAST_BYTES


def chunks(documents: DataFrame, size: int = 1500, overlap: int = 150, source: str | None = None) -> DataFrame:
    """(content, source, group_id, chunk_no) of documents (text, source, group_id); chunks under 50 bytes are dropped."""
    name = F.lit(source) if source else F.col("source")
    each = documents.where("text IS NOT NULL").select(name.alias("source"), "group_id", F.posexplode(chunk_windows(F.col("text"), size, overlap)).alias("chunk_no", "content"))
    return each.where(enough_text(F.col("content"))).select("content", "source", "group_id", "chunk_no")


def enqueue(spark: SparkSession, root: str, group_id: str = "default", source: str | None = None, pdf: PdfReader | None = None) -> DataFrame:
    """The jobs that a folder gives."""
    documents = texts(walk(spark, root), pdf).select("text", F.col("path").alias("source"), F.lit(group_id).alias("group_id"))
    return jobs.push(chunks(documents, source=source))
