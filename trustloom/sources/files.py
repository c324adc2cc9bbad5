"""Text files, folders, repositories and transcripts as records; what cannot be read becomes a failure row."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.operators.chunk import MOST, OVERLAP, chunked

# fixed values
EXTENSIONS = (".md .markdown .rst .txt .text .json .yaml .yml .toml .cfg .ini .env .csv .tsv .xml .html .htm .css .py .pyi .js .jsx .mjs .cjs .ts .tsx "
              ".java .kt .go .rs .rb .php .c .h .cc .cpp .hpp .cs .swift .scala .sh .bash .zsh .sql .r .lua .pl").split()
GIT_SECONDS = 15


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/+", "/")


def read_texts(spark: SparkSession, path: str, extensions=EXTENSIONS, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(path, text) of valid UTF-8 files and (path, error) of others; by path. A missing path is a failure, too."""
    schema = "path string, text string"
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select(_plain(F.col("path")).alias("path"), "content")
    except Exception as error:  # Spark names a path that is not there when the frame is made
        if "PATH_NOT_FOUND" not in str(error) and "does not exist" not in str(error):
            raise
        return spark.createDataFrame([], schema), spark.createDataFrame([(path, "not found")], "path string, error string")
    if extensions is not None:
        wanted = [e.lower() if e.startswith(".") else "." + e.lower() for e in extensions]
        found = found.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(wanted))
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.col("content").cast("string"), r"^\x{FEFF}", "")
    return (found.filter(good).select("path", text.alias("text")).orderBy("path"),
            found.filter(~good).select("path", F.lit("not UTF-8").alias("error")).orderBy("path"))


def records_of(texts: DataFrame, ref: Column, source_type: str, scope: str = "global", scope_ref: str | None = None, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """A record for every chunk of every text, with an id that follows from its source and content."""
    rows = chunked(texts.withColumn("_ref", ref), "text", most, overlap)
    source = F.concat("_ref", F.lit("#chunk="), F.col("chunk_index").cast("string"))
    h = F.sha2(F.concat_ws("\u0001", source, "chunk"), 256)
    variant = F.substr(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    uuid = F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
    return rows.select(uuid.alias("memory_id"), F.col("chunk").alias("content"), F.lit(source_type).alias("source_type"), source.alias("source_ref"),
                       F.lit(scope).alias("scope"), F.lit(scope_ref).cast("string").alias("scope_ref"), "chunk_index")


def file_records(spark: SparkSession, path: str, **where) -> tuple[DataFrame, DataFrame]:
    good, bad = read_texts(spark, path, None)
    return records_of(good, F.concat(F.lit("file://"), "path"), "file", **where), bad


def folder_records(spark: SparkSession, path: str, extensions=EXTENSIONS, **where) -> tuple[DataFrame, DataFrame]:
    good, bad = read_texts(spark, path, extensions)
    return records_of(good, F.concat(F.lit("file://"), "path"), "file", **where), bad


def commit_of(path: str) -> str:
    """The head commit, or `worktree` where there is none to be had."""
    try:
        run = subprocess.run(["git", "-C", path, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=GIT_SECONDS)
    except (OSError, subprocess.TimeoutExpired):
        return "worktree"
    return run.stdout.strip() if run.returncode == 0 and run.stdout.strip() else "worktree"


def repo_records(spark: SparkSession, path: str, extensions=EXTENSIONS, scope: str = "repo", scope_ref: str | None = None, **sizes) -> tuple[DataFrame, DataFrame]:
    root = os.path.abspath(path)
    good, bad = read_texts(spark, root, extensions)
    good = good.filter(~F.col("path").rlike(r"/\.git/"))
    inside = F.substr("path", F.lit(len(root) + 2))
    ref = F.concat(F.lit("repo://"), inside, F.lit("@" + commit_of(root)))
    return records_of(good, ref, "commit", scope, scope_ref or os.path.basename(root), **sizes), bad


def path_records(spark: SparkSession, path: str, **where) -> tuple[DataFrame, DataFrame]:
    """A file, a folder with .git, or any other folder."""
    if os.path.isfile(path):
        return file_records(spark, path, **where)
    if os.path.isdir(os.path.join(path, ".git")):
        return repo_records(spark, path, **where)
    if os.path.isdir(path):
        return folder_records(spark, path, **where)
    raise FileNotFoundError(path)


def transcripts(spark: SparkSession, path: str, root: str | None = None, source_type: str = "file") -> DataFrame:
    """(source_ref, source_type, text) of transcript files; what is no UTF-8 becomes U+FFFD, references are relative to root."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    plain = _plain(F.col("path"))
    start = len(os.path.abspath(root)) + 1 if root else 0
    ref = F.when(F.startswith(plain, F.lit(os.path.abspath(root) + "/")), F.substr(plain, F.lit(start + 1))).otherwise(plain) if root else plain
    return rows.select(ref.alias("source_ref"), F.lit(source_type).alias("source_type"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def conversation_transcripts(conversations: DataFrame) -> DataFrame:
    """(source_ref, source_type, text): one line a turn, under its conversation's name."""
    return conversations.select(F.concat(F.lit("conversation-"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("source_ref"),
                                F.lit("api").alias("source_type"), F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("text"))


def json_queue(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """Rows of {member: [...]}; a missing or corrupt file has none."""
    try:
        whole = spark.read.schema(f"`{member}` array<struct<{schema}>>").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "does not exist" not in str(error):
            raise
        return spark.createDataFrame([], ", ".join(schema.replace(":", " ").split(",")))
    return whole.select(F.inline(F.col(member)))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines log; blanks are skipped, a missing log is empty."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "does not exist" not in str(error):
            raise
        return spark.createDataFrame([], schema)
