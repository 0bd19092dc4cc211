"""File trees as tables: files, folders, their graph records, and the log of what was read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text

# The older pipeline's whitelist of suffixes and names.
OLD_CODE = (".py", ".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".ipp", ".js", ".jsx", ".ts", ".tsx", ".java", ".kt", ".go", ".rs", ".gn", ".gni", ".sh", ".bash", ".ps1", ".swift")
OLD_DOCS = (".md", ".rst", ".txt", ".adoc", ".markdown", ".xml", ".html")
OLD_CONFIG = (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(source_file, bytes, size_bytes) of every file below a folder, without any filter on the suffix."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/") + "/")
    full = F.regexp_replace(F.col("path"), "^file:/*", "/")
    found = raw.select(F.substring(full, F.length(base) + 1, F.lit(2**30)).alias("source_file"), F.col("content").alias("bytes"), F.col("length").alias("size_bytes"))
    none = spark.createDataFrame([(p,) for p in empty_files(spark, root)], "source_file string")
    return found.unionByName(none.select("source_file", F.lit(bytearray()).alias("bytes"), F.lit(0).cast("long").alias("size_bytes")))


def empty_files(spark: SparkSession, root: str) -> list[str]:
    """Files without a byte, which the scan of binary files leaves out: names from the file system's own listing."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toUri().getPath().rstrip("/") + "/"
    out, it = [], fs.listFiles(top, True)
    while it.hasNext():
        f = it.next()
        if f.getLen() == 0:
            out.append(f.getPath().toUri().getPath().removeprefix(base))
    return out


def with_text(files: DataFrame) -> DataFrame:
    """Adds binary, content (null for binary files), language, bucket, line_count and sha256_hash."""
    binary = text.is_binary(F.col("bytes"))
    out = files.withColumn("binary", binary).withColumn("content", F.when(~F.col("binary"), text.decode(F.col("bytes"))))
    out = out.withColumn("language", paths.language(F.col("source_file")))
    return out.withColumns({
        "bucket": paths.bucket(F.col("language"), F.col("source_file"), F.col("binary")),
        "line_count": text.line_count(F.coalesce("content", F.lit("")), F.col("binary")),
        "sha256_hash": F.sha2("bytes", 256),
    }).drop("bytes")


def in_scope(files: DataFrame, prefix: str = "", strict: bool = False) -> DataFrame:
    """Files whose path stays inside the tree and starts with the prefix; strict raises on one that leaves it."""
    leaves = paths.normal(F.col("source_file")).startswith("..") | F.col("source_file").startswith("/")
    if strict:
        checked = F.when(leaves, F.raise_error(F.concat(F.lit("outside the tree: "), F.col("source_file")))).otherwise(F.col("source_file"))
        files = files.withColumn("source_file", checked)
    else:
        files = files.where(~leaves)
    return files.where(F.col("source_file").startswith(prefix)) if prefix else files


def whitelisted(files: DataFrame) -> DataFrame:
    """The older pipeline's choice of files."""
    s, n = F.lower(paths.suffix(F.col("source_file"))), F.upper(paths.name(F.col("source_file")))
    return files.where(s.isin(*OLD_CODE, *OLD_DOCS, *OLD_CONFIG) | n.startswith("KCONFIG") | (n == "CMAKELISTS.TXT"))


def folders(files: DataFrame) -> DataFrame:
    """(source_file, name, parent): every folder above any file, the root ``.`` included."""
    above = files.select(F.explode(paths.ancestors(F.col("source_file"))).alias("source_file")).distinct()
    return above.select("source_file", F.when(F.col("source_file") == ".", F.lit(".")).otherwise(paths.name(F.col("source_file"))).alias("name"), paths.parent(F.col("source_file")).alias("parent"))


def empty_folders(root: str) -> list[str]:
    """Folders without files, which no file names; a walk of folder names only."""
    return sorted(os.path.relpath(d, root) for d, dirs, names in os.walk(root) if not dirs and not names)


def contains_edges(files: DataFrame) -> DataFrame:
    """(subject, object): folder to folder and folder to file."""
    a = folders(files).where("parent is not null").select(F.concat(F.lit("Folder|"), "parent").alias("subject"), F.concat(F.lit("Folder|"), "source_file").alias("object"))
    b = files.select("source_file").distinct().select(F.concat(F.lit("Folder|"), paths.parent(F.col("source_file"))).alias("subject"), F.concat(F.lit("SourceFile|"), "source_file").alias("object"))
    return a.unionByName(b)


def file_entities(files: DataFrame) -> DataFrame:
    """SourceFile records with their metadata."""
    meta = F.to_json(F.struct(paths.suffix(F.col("source_file")).alias("extension"), "size_bytes", "sha256_hash", F.col("bucket").alias("detected_type"), "language"))
    return files.select(
        F.concat(F.lit("SourceFile|"), "source_file").alias("uid"), paths.name(F.col("source_file")).alias("name"), F.lit("SourceFile").alias("entity_type"), "source_file",
        F.lit(1).alias("line_start"), F.greatest(F.lit(1), "line_count").alias("line_end"), F.lit("filesystem-walk").alias("extraction_method"), meta.alias("metadata"),
    )


def access_log(files: DataFrame) -> DataFrame:
    """One row per file: whether it lies in scope, for an append-only log."""
    leaves = paths.normal(F.col("source_file")).startswith("..")
    return files.select(F.current_timestamp().alias("at"), F.col("source_file").alias("path"), (~leaves).alias("within_scope"), F.lit("read").alias("operation"))


def write_access_log(files: DataFrame, where: str) -> None:
    access_log(files).write.mode("append").json(where)
