"""Documents from files: names, hashes, types, page counts, duplicates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T

# Extensions and the types they stand for.
MIME_TYPES = {
    "csv": "text/csv", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "gif": "image/gif", "htm": "text/html", "html": "text/html", "jpeg": "image/jpeg", "jpg": "image/jpeg", "json": "application/json",
    "md": "text/markdown", "pdf": "application/pdf", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff", "txt": "text/plain",
    "webp": "image/webp", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xml": "text/xml",
}
OCTETS = "application/octet-stream"


def looks_like_pdf(content: Column) -> Column:
    return F.contains(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), F.lit("%PDF-"))


def mime_resolution(filename: Column, supplied: Column, content: Column | None = None) -> Column:
    """Supplied type unless it is generic, else by extension; a PDF signature in the first KiB wins."""
    ext = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    by_ext = F.lit(None).cast("string")
    for e, m in MIME_TYPES.items():
        by_ext = F.when(ext == e, m).otherwise(by_ext)
    named = F.when(supplied.isNotNull() & ~supplied.isin("", OCTETS), supplied).otherwise(F.coalesce(by_ext, F.lit(OCTETS)))
    return named if content is None else F.when(looks_like_pdf(content), "application/pdf").otherwise(named)


def pdf_page_count(content: Column) -> Column:
    """Pages of a PDF from its page objects, else from the linearization header; 1 for anything else."""
    text = F.decode(content, "ISO-8859-1")
    objects = F.regexp_count(text, F.lit(r"/Type\s*/Page\b"))
    linear = F.regexp_extract(F.substring(text, 1, 4096), r"(?s)/Linearized\s+1.*?/N\s+(\d+)", 1).try_cast("int")
    counted = F.when(objects > 0, objects).otherwise(F.greatest(F.coalesce(linear, F.lit(1)), F.lit(1)))
    return F.when(looks_like_pdf(content), counted).otherwise(1)


def ingest_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a path as documents: cleaned name, content hash, size, type and page count."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return document_columns(files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.lit(None).cast("string").alias("supplied"),
                                         "content", F.col("modificationTime").alias("created_at"), "path"))


def document_columns(files: DataFrame) -> DataFrame:
    """Shared derivation for files and tables of (name, supplied, content, created_at, path)."""
    name = T.clean_filename(F.col("name"))
    return files.select(name.alias("filename"), F.sha2("content", 256).alias("sha256"), F.length("content").alias("size_bytes"),
                        mime_resolution(name, F.col("supplied"), F.col("content")).alias("mime_type"),
                        pdf_page_count(F.col("content")).alias("page_count"), "created_at", "path")


def dedup_by_content(documents: DataFrame, scope: list[str] = []) -> DataFrame:
    """All documents with the surviving id of their content hash and a duplicate flag.

    The survivor is found by a map-side combined min_by, so a hash shared by many copies is reduced before the
    shuffle; the one-row-per-hash result is joined back (adaptive execution splits a skewed hash).
    """
    keys = [*scope, "sha256"]
    first = documents.groupBy(*keys).agg(F.min_by("document_id", F.struct("created_at", "document_id")).alias("survivor_id"))
    return documents.join(first, keys).withColumn("duplicate", F.col("document_id") != F.col("survivor_id"))


def conflicting_duplicate_annotations(files: DataFrame) -> DataFrame:
    """Content hashes whose copies carry different annotations (an absent annotation counts as one)."""
    truth = F.coalesce("truth_json", F.lit("<none>"))
    return (files.groupBy("sha256").agg(F.min(truth).alias("_a"), F.max(truth).alias("_b"), F.count(F.lit(1)).alias("files"))
            .where(F.col("_a") != F.col("_b")).select("sha256", "files"))


def import_plan(files: DataFrame, documents: DataFrame, truth: DataFrame) -> DataFrame:
    """Per file: existing document, duplicate flag and what happens to its annotation."""
    known = documents.groupBy("sha256").agg(F.min("document_id").alias("document_id"))
    annotated = truth.select("document_id").distinct().withColumn("_t", F.lit(True))
    first = files.groupBy("sha256").agg(F.min("filename").alias("_first"))
    j = files.join(known, "sha256", "left").join(first, "sha256").join(annotated, "document_id", "left")
    action = F.when(F.col("_t"), "preserve_existing").when(F.col("truth_json").isNotNull(), "save").otherwise("none")
    return j.select("filename", "sha256", "document_id", (F.col("document_id").isNotNull() | (F.col("filename") != F.col("_first"))).alias("duplicate"), action.alias("annotation_action"))
