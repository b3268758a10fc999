"""Files as tables, and tables back to files."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by file suffix, in order; the first that has a suffix counts.
LANGUAGES = {
    "python": [".py"],
    "javascript": [".js"],
    "typescript": [".ts", ".tsx"],
    "java": [".java"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".hpp", ".cc", ".hh", ".cxx", ".hxx"],
    "ruby": [".rb"],
    "go": [".go"],
    "rust": [".rs"],
    "swift": [".swift"],
    "php": [".php"],
    "csharp": [".cs"],
    "kotlin": [".kt", ".kts"],
    "scala": [".scala"],
    "html": [".html", ".htm", ".xhtml", ".html5"],
    "css": [".css", ".scss", ".sass", ".less", ".styl"],
    "xml": [".xml", ".xsd", ".xsl", ".xslt", ".rss", ".svg", ".svgz"],
    "yaml": [".yaml", ".yml"],
    "json": [".json", ".json5", ".jsonl", ".geojson", ".topojson", ".jsonc"],
    "markdown": [".md", ".markdown", ".mdown", ".mdwn", ".mkd", ".mkdn"],
    "jinja": [".j2", ".jinja", ".jinja2"],
    "config": [".ini", ".cfg", ".conf", ".properties", ".toml", ".env"],
    "documentation": [".txt", ".text", ".tex", ".bib"],
    "container": ["Dockerfile", "docker-compose.yml", "docker-compose.yaml", ".dockerignore"],
}

# Endings of names of files that are not text.
SKIPPED = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".heic", ".heif", ".ico", ".icns",
    ".psd", ".ai", ".eps", ".mp3", ".wav", ".flac", ".aac", ".ogg", ".m4a", ".wma", ".aiff", ".mp4", ".mkv",
    ".mov", ".avi", ".wmv", ".flv", ".webm", ".mpeg", ".mpg", ".3gp", ".ttf", ".otf", ".woff", ".woff2",
    ".eot", ".zip", ".tar", ".gz", ".bz2", ".xz", ".rar", ".7z", ".iso", ".dmg", ".db", ".sqlite", ".sqlite3",
    ".mdb", ".accdb", ".dbf", ".frm", ".myd", ".myi", ".ndf", ".ldf", ".sys", ".dll", ".exe", ".bin", ".msi",
    ".obj", ".o", ".so", ".dylib", ".class", ".lock", ".tmp", ".log", ".bak", ".swp", ".swo", ".ds_store",
    "thumbs.db", ".stl", ".fbx", ".blend", ".dae", ".3ds", ".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls",
    ".xlsx", ".odt", ".ods", ".odp",
]

#: What stands for the content of a file that is not text.
PLACEHOLDER = "< suppressed bytes content >"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    """The language of a path by its suffix, or by its whole name; null if there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.lit(None).cast("string")
    for lang, endings in reversed(LANGUAGES.items()):
        dotted = [e for e in endings if e.count(".") == 1 and e.startswith(".")]
        whole = [e for e in endings if e not in dotted or e == ".dockerignore"]
        hit = suffix(path).isin(*dotted) if dotted else F.lit(False)
        out = F.when(hit | name.isin(*whole) if whole else hit, lang).otherwise(out)
    return out


def skipped(path: Column) -> Column:
    """Whether a file's name ends in a way that marks it as no text."""
    return F.lower(F.element_at(F.split(path, "/"), -1)).rlike("(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")$")


def scan(spark: SparkSession, root: str, languages: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """files (path, language, mtime, length, raw, is_text) below root; paths are relative to it.

    keep restricts to listed paths, such as those of git_paths.  Content that is not UTF-8, or whose name says it
    is no text, has a placeholder.  Languages filter before content is decoded.  A file that can't be read is an error.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.col("path"), rf"^.*?\Q{root.rstrip('/')}\E/", "")
    files = found.select(path.alias("path"), F.col("modificationTime").alias("mtime"), "length", "content").withColumn("language", language(F.col("path")))
    if languages:
        files = files.where(F.col("language").isin(*languages))
    if keep is not None:
        files = files.join(spark.createDataFrame([(p,) for p in keep], "path string"), "path", "left_semi")
    text = F.when(~skipped(F.col("path")), F.try_validate_utf8(F.col("content").cast("string")))
    return files.withColumn("is_text", text.isNotNull()).select("path", "language", "mtime", "length", F.coalesce(text, F.lit(PLACEHOLDER)).alias("raw"), "is_text")


def git_paths(root: str) -> list[str] | None:
    """Tracked files and untracked ones that are not ignored; null where root is no repository."""
    out = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, text=True)
    return None if out.returncode else sorted(set(filter(None, out.stdout.split("\0"))))


def by_language(files: DataFrame) -> DataFrame:
    """language, n_files, paths (in order)."""
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.array_sort(F.collect_list("path")).alias("paths"))


def save(tables: dict[str, DataFrame], path: str) -> None:
    """A snapshot: one Parquet folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_texts(files: DataFrame, path: str) -> None:
    """files (path, content) as text, one folder per path."""
    files.select(F.col("content").alias("value"), F.url_encode("path").alias("file")).write.mode("overwrite").partitionBy("file").text(path)
