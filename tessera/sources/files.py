"""Scans of Markdown directories, source trees, JSON logs and small state files."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..schema import KIND_SCOPES, LEDGER

MAX_FILE_BYTES = 500_000
#: Suffixes of source code.
CODE_SUFFIXES = (
    ".py", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".go", ".rs", ".java", ".kt", ".kts", ".scala", ".c", ".cc", ".cpp", ".h", ".hh", ".hpp", ".cs",
    ".rb", ".php", ".swift", ".m", ".mm", ".sh", ".bash", ".zsh", ".fish", ".sql", ".graphql", ".proto", ".yaml", ".yml", ".toml", ".json", ".html", ".css", ".scss", ".sass",
    ".less", ".vue", ".svelte", ".lua", ".nim", ".ex", ".exs", ".erl", ".hs", ".ml", ".fs", ".fsx", ".clj", ".cljs", ".dart", ".r", ".jl", ".tf", ".dockerfile",
)
#: Directories that are never scanned for source code.
IGNORED_DIRECTORIES = (
    ".git", ".hg", ".svn", "__pycache__", ".venv", "venv", "env", "node_modules", ".next", ".nuxt", "dist", "build", "target", ".gradle", ".idea", ".vscode", ".cache", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".claude",
)


_BINARY = "path string, modificationTime timestamp, length long, content binary"


def _listed(root: str, pattern: str, recursive: bool, enter: Callable[[str], bool]) -> list[tuple[str, datetime, int]]:
    out = []
    for d, below, names in os.walk(root):
        below[:] = sorted(x for x in below if enter(x)) if recursive else []
        for n in sorted(names):
            if fnmatch.fnmatchcase(n, pattern):
                s = os.stat(path := os.path.join(d, n))
                out.append((path, datetime.fromtimestamp(s.st_mtime, UTC), s.st_size))
    return out


def _binary(spark: SparkSession, root: str, glob: str, recursive: bool = True, enter: Callable[[str], bool] = lambda _: True, most: int = 64 << 20) -> DataFrame:
    """path, modificationTime, length and content of files; no row if there is no such directory.

    Spark's own reader passes over names that begin with ``_`` or ``.`` and over empty files,
    which source trees have.  So directories of a mounted file system are listed here, with
    pruning, and the files (of at most ``most`` bytes) are read by the executors; other file
    systems are left to Spark's reader.
    """
    if re.match(r"(?!file:)[a-z][a-z0-9+.-]*:", root):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], _BINARY)
        reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
        return (reader.option("recursiveFileLookup", "true") if recursive else reader).load(root)
    found = _listed(re.sub(r"^file:/+", "/", root), glob, recursive, enter)
    table = spark.createDataFrame(found, "path string, modificationTime timestamp, length long")

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            content = []
            for f, n in zip(p["path"], p["length"], strict=True):
                with open(f, "rb") as x:
                    content.append(x.read() if n <= most else None)
            yield p.assign(content=content)

    return table.repartition(max(1, min(len(found) // 64, 10_000))).mapInPandas(read, _BINARY)


def markdown_files(spark: SparkSession, root: str, kind: str = "memory_global", *, recursive: bool = True) -> DataFrame:
    """path, scope, file_hash, modified and text of the Markdown files of a directory; none if it doesn't exist."""
    rows = _binary(spark, root, "*.md", recursive)
    return rows.select("path", F.lit(KIND_SCOPES.get(kind, kind)).alias("scope"), F.sha2("content", 256).alias("file_hash"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))


def code_files(spark: SparkSession, root: str, *, suffixes: tuple[str, ...] = CODE_SUFFIXES, ignored: tuple[str, ...] = (), max_files: int | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path, language, file_hash, too_large and text of the source files under a directory.

    Hidden files and directories (but .github) and ignored directories are passed over.  Files that
    are empty or too large are listed without text, so that a change plan can drop what they had.
    ``max_files`` keeps the first by path.
    """
    pruned = {*IGNORED_DIRECTORIES, *ignored}
    rows = _binary(spark, root, "*", enter=lambda d: d not in pruned and (d == ".github" or not d.startswith(".")))
    rel = F.substring(F.col("path"), len(root.rstrip("/")) + 2, 1 << 20)
    parts = F.split(rel, "/")
    above, name = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
    skipped = F.array(*[F.lit(x) for x in (*IGNORED_DIRECTORIES, *ignored)])
    ok = ~F.arrays_overlap(above, skipped) & ~F.exists(above, lambda d: d.startswith(".") & (d != ".github")) & ~name.startswith(".") & X.suffix(F.col("path")).isin(*suffixes)
    rows = rows.filter(ok)
    if max_files is not None:
        rows = rows.orderBy("path").limit(max_files)
    fits = F.col("length").between(1, max_bytes)
    return rows.select("path", X.language(F.col("path")).alias("language"), F.sha2("content", 256).alias("file_hash"), (~fits).alias("too_large"), F.when(fits, F.decode("content", "UTF-8")).alias("text"))


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no and value of every line of JSON logs, in file order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("_t"))
    return whole.select("file", F.posexplode(F.split("_t", "\n", -1)).alias("line_no", "value"))


def read_ledger(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """Entries of the cost ledger out of lines; blank and malformed lines are passed over."""
    bad = F.try_parse_json(F.col(value)).isNull()
    rows = lines.filter((X.strip(F.col(value)) != "") & ~bad)
    return rows.select(F.from_json(value, LEDGER, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")


def latest_file(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, modified and text of the file changed last; no row if there is none."""
    rows = _binary(spark, root, glob).agg(F.max_by(F.struct("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text")), F.struct("modificationTime", "path")).alias("f"))
    return rows.filter("f IS NOT NULL").select("f.*")


def session_state(states: DataFrame, session_id: str | None) -> DataFrame:
    """The state of a session, or of the one changed last if it has none: session_id, modified, state."""
    wanted = F.coalesce(F.col("session_id") == F.lit(session_id), F.lit(False)) if session_id else F.lit(False)
    return states.orderBy(F.desc(wanted), F.desc("modified"), "session_id").limit(1)


def first_by_file(lines: DataFrame, column: str) -> DataFrame:
    """The first value of a column per file that isn't null, in the order of lines."""
    w = Window.partitionBy("file").orderBy("line_no")
    rows = lines.filter(F.col(column).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return rows.select("file", column)
