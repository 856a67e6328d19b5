"""Sources: parquet tables, CSV, JSON records, CoNLL text, web pages, taxonomies, feedback records."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, folder: str, names: list[str] | None = None, views: bool = False) -> dict[str, DataFrame]:
    """Lazy parquet scans by name; with ``views`` each is a temp view too, so that SQL text can name it."""
    out = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names or TABLES}
    if views:
        for n, df in out.items():
            df.createOrReplaceTempView(n)
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: names in lower case and trimmed, missing cells empty, double quotes quote (an apostrophe does not)."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return df.toDF(*[c.strip().lower() for c in df.columns]).na.fill("")


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder of JSON objects or lists of objects, one document a file."""
    return spark.read.option("multiLine", True).json(path)


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """``file, sent, pos, token, label`` of tab-separated token files with a blank line between sentences."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    sents = files.select("file", F.posexplode(F.split("value", "\n[ \t]*\n+")).alias("sent", "body"))
    rows = sents.select("file", "sent", F.posexplode(F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    return rows.select("file", "sent", "pos", F.split_part("line", F.lit("\t"), F.lit(1)).alias("token"), F.split_part("line", F.lit("\t"), F.lit(-1)).alias("label"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, length, content`` of binary files; extraction of formats beyond plain text is left to the caller's function."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


#: Parts of zipped documents that hold text, and the tags (without namespace) that end a line in them, hold a tab, or hold text.
_PARTS = {"word/document.xml": ("p", "tab", "t"), "content.xml": ("p", "tab", None)}
_PLAIN = ("txt", "md", "csv", "log")


def _zipped_text(content: bytes, longest: int) -> str:
    """Text of a zipped XML document, read as a stream of tags: the tree is dropped as it goes, and no more than ``longest`` bytes of it are unpacked."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        name = next((n for n in _PARTS if n in z.namelist()), None)
        if name is None or z.getinfo(name).file_size > longest:
            raise ValueError("no text part" if name is None else "too long")
        line, tab, run = _PARTS[name]
        out: list[str] = []
        with z.open(name) as f:
            for _, node in ElementTree.iterparse(f):
                tag = node.tag.rpartition("}")[2]
                if tag == tab:
                    out.append("\t")
                elif run and tag == run:
                    out.append(node.text or "")
                elif tag == line or (not run and tag == "h"):
                    out.append("".join(node.itertext()) + "\n" if not run else "\n")
                if tag == line or tag == "h":
                    node.clear()
        return "".join(out).strip("\n")


def _texts(longest: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                kind, text, error = path.rpartition(".")[2].lower(), None, None
                try:
                    text = content.decode("utf-8-sig", "replace") if kind in _PLAIN else _zipped_text(content, longest)
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, RuntimeError, NotImplementedError) as e:
                    error = f"{type(e).__name__}: {e}"[:200]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (path, kind, text, error)], ["path", "kind", "text", "error"])

    return run


def read_office(spark: SparkSession, path: str, newer_than: str | None = None, longest: int = 64 << 20) -> DataFrame:
    """``path, kind, text, error`` of plain and zipped XML documents (txt, md, csv, log, docx, odt), one row a file.

    Files are split over tasks by Spark, and those that are not newer or are over ``longest`` bytes are left out before they are opened, as the
    filters reach the listing.  A file that cannot be read has its reason instead of a text.  In a text of an odt file tables' cells are lines.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md,csv,log,docx,odt}").option("recursiveFileLookup", True).load(path).filter(F.col("length") <= longest)
    if newer_than:
        files = files.filter(F.col("modificationTime") > F.lit(newer_than).cast("timestamp"))
    return files.select("path", "content").mapInArrow(_texts(longest), "path string, kind string, text string, error string")


def read_feedback(spark: SparkSession, path: str, limit: int, kind: str | None = None) -> DataFrame:
    """The newest ``limit`` records by file name, then those of one ``kind``: the limit comes first.

    Names are listed without opening the files; only the newest, at most ``limit``, are parsed.
    """
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path")
    newest = [r["path"] for r in names.orderBy(F.col("path").desc()).limit(limit).collect()]  # at most ``limit`` names
    if not newest:
        return spark.createDataFrame([], "type string, file string")
    df = spark.read.option("multiLine", True).json(newest).withColumn("file", F.input_file_name())
    df = df.orderBy(F.col("file").desc()).limit(limit)
    return df.filter(F.col("type") == kind) if kind else df


def taxonomy(spark: SparkSession, rows: list[tuple[str, str]], domain: str = "general") -> DataFrame:
    """``name, domain`` of a small term list; blank domains get the default."""
    df = spark.createDataFrame(rows, "name string, domain string")
    return df.withColumn("domain", F.coalesce(F.nullif(F.trim("domain"), F.lit("")), F.lit(domain)))


def training_export(labelled: DataFrame, records: DataFrame, key: str, actions: list[str], text: str) -> DataFrame:
    """Labelled records of given actions that have text, with that text."""
    return labelled.filter(F.col("action").isin(actions)).join(records.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(key, text), key)
