"""Text and PDF files as document rows.

A document row is (path, source, file_type, ordinal, text, metadata). Spark's file listing leaves out
names that begin with a dot or underscore and files of no bytes. Such files are documents too: the
former are copied into the shared folder under other names and read there, the latter are rows
without text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import pdf
from granary.functions.text import basename
from granary.shared import new_folder, stored

SCHEMA = "path string, source string, file_type string, ordinal long, text string, metadata map<string,string>"
_ROWS = "path string, source string, file_type string, page int, text string, metadata map<string,string>"

#: From the bytes of a PDF to its pages: texts, or (text, metadata) pairs.
PdfParser = Callable[[bytes], list]


def _numbered(docs: DataFrame) -> DataFrame:
    """Ordinals in the order of names.

    The rows are stored in that order, which evaluates scan and parser once; a row's ordinal is
    its place in its part file and the number of rows in the files before, a few counts.
    """
    kept = stored(docs.orderBy("source", "path", "page"), "documents")
    placed = kept.select("*", F.col("_metadata.file_name").alias("_part"), F.col("_metadata.row_index").alias("_at"))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").select(  # a row for each part file
        "path", "source", "file_type", (F.col("_before") + F.col("_at")).cast("long").alias("ordinal"), "text", "metadata"
    )


def decoded(content: Column) -> Column:
    """Strict UTF-8 with one kind of line end, for batches and streams alike."""
    return F.regexp_replace(F.decode(content, "UTF-8"), "\r\n?", "\n")


def _texts(files: DataFrame) -> DataFrame:
    return files.select(
        "path", basename(F.col("path")).alias("source"), F.lit("text").alias("file_type"), F.lit(0).alias("page"),
        decoded(F.col("content")).alias("text"), F.create_map().cast("map<string,string>").alias("metadata"),
    )


def _pdfs(files: DataFrame, parse: PdfParser | None) -> DataFrame:
    """Pages by the parser. Its metadata is kept, but for ``source`` and ``file_type``, which are the scan's."""
    if parse is None:
        return files.sparkSession.createDataFrame([], _ROWS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                pages = [(p, {}) if isinstance(p, str) else p for p in parse(bytes(content))]
                meta = [{k: None if v is None else str(v) for k, v in m.items() if k not in ("source", "file_type")} for _, m in pages]
                yield pd.DataFrame({"path": path, "page": range(len(pages)), "text": [t for t, _ in pages], "metadata": meta}, columns=["path", "page", "text", "metadata"])

    pages = files.select("path", "content").mapInPandas(run, "path string, page int, text string, metadata map<string,string>")
    return pages.select("path", basename(F.col("path")).alias("source"), F.lit("pdf").alias("file_type"), "page", "text", "metadata")


def _left_out(spark: SparkSession, statuses: list) -> DataFrame | None:
    """(path, content) of those files that Spark's listing leaves out; None if there are none.

    The copies are made by the file system, not held in memory; they serve until the scan is
    stored.
    """
    empty = [str(f.getPath()) for f in statuses if f.getLen() == 0]
    hidden = [f for f in statuses if f.getLen() > 0 and f.getPath().getName()[0] in "._"]
    rows = spark.createDataFrame([(p, bytearray()) for p in empty], "path string, content binary") if empty else None
    if hidden:
        folder, jvm, conf = new_folder(spark, "left-out"), spark._jvm, spark._jsc.hadoopConfiguration()
        for k, f in enumerate(hidden):
            target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{k}.file")
            jvm.org.apache.hadoop.fs.FileUtil.copy(f.getPath().getFileSystem(conf), f.getPath(), target.getFileSystem(conf), target, False, conf)
        names = spark.createDataFrame([(k, str(f.getPath())) for k, f in enumerate(hidden)], "k int, named string")
        copies = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"(\d+)\.file$", 1).cast("int").alias("k"), "content")
        copied = copies.join(names, "k").select(F.col("named").alias("path"), "content")
        rows = copied if rows is None else rows.unionByName(copied)
    return rows


def _all_of(listed: DataFrame, left_out: DataFrame | None) -> DataFrame:
    files = listed.select("path", "content")
    return files if left_out is None else files.unionByName(left_out)


def scan_files(spark: SparkSession, paths: list[str], parse_pdf: PdfParser | None = pdf.pages) -> DataFrame:
    """Documents of the named files: ``.pdf`` by the parser, anything else as text."""
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    jvm, conf, odd = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for name in dict.fromkeys(paths):
        path = jvm.org.apache.hadoop.fs.Path(name)
        found = path.getFileSystem(conf).globStatus(path) or []
        odd += [(name, f) for f in found if f.isFile() and (f.getLen() == 0 or f.getPath().getName()[0] in "._")]
    alone = {name for name, f in odd if str(f.getPath().getName()) == name.rsplit("/", 1)[-1]}  # a name that is no pattern
    plain = [p for p in paths if p not in alone]
    listed = spark.read.format("binaryFile").load(plain) if plain else spark.createDataFrame([], "path string, content binary")
    files = _all_of(listed, _left_out(spark, [f for _, f in odd]))
    is_pdf = F.endswith(F.lower("path"), F.lit(".pdf"))
    return _numbered(_texts(files.where(~is_pdf)).unionByName(_pdfs(files.where(is_pdf), parse_pdf)))


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def scan_folder(spark: SparkSession, folder: str, parse_pdf: PdfParser | None = pdf.pages) -> DataFrame:
    """Documents of a folder's own ``.txt`` and ``.pdf`` files in any case; none if there is no such folder."""
    if not folder_exists(spark, folder):
        return spark.createDataFrame([], SCHEMA)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    suffixed = lambda f: f.isFile() and f.getPath().getName().lower().endswith((".txt", ".pdf"))
    statuses = [f for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if suffixed(f)]
    seen = [f for f in statuses if f.getLen() > 0 and f.getPath().getName()[0] not in "._"]
    if seen:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", "*.[tTpP][xXdD][tTfF]").load(folder)
    else:
        listed = spark.createDataFrame([], "path string, content binary")
    files = _all_of(listed, _left_out(spark, statuses))
    name = F.lower("path")
    texts = _texts(files.where(F.endswith(name, F.lit(".txt"))))
    return _numbered(texts.unionByName(_pdfs(files.where(F.endswith(name, F.lit(".pdf"))), parse_pdf)))


def documents_from(
    spark: SparkSession, paths: list[str] | None, raw_folder: str, sample_folder: str, parse_pdf: PdfParser | None = pdf.pages
) -> DataFrame:
    """The named files; with none named, the raw folder; if that has no document, the samples."""
    if paths:
        return scan_files(spark, paths, parse_pdf)
    raw = scan_folder(spark, raw_folder, parse_pdf)
    return scan_folder(spark, sample_folder, parse_pdf) if raw.isEmpty() else raw
