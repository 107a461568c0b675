"""Source files as a DataFrame: scan filters, language, metadata, folders, contents, trees."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import glob_regex, under
from ..session import ship

MAX_FILE_SIZE = 1 << 20
#: Languages by file name and by extension.
BY_NAME = {"Dockerfile": "dockerfile", "Makefile": "makefile", "Jenkinsfile": "groovy", "Vagrantfile": "ruby", "Gemfile": "ruby", "Rakefile": "ruby"}
BY_EXTENSION = {
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "py": "python",
    "pyi": "python",
    "rs": "rust",
    "go": "go",
    "java": "java",
    "cs": "csharp",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "hpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "hh": "cpp",
    "hxx": "cpp",
    "rb": "ruby",
    "erb": "ruby",
    "json": "json",
    "yaml": "yaml",
    "yml": "yaml",
    "toml": "toml",
    "xml": "xml",
    "ini": "ini",
    "cfg": "ini",
    "env": "dotenv",
    "html": "html",
    "htm": "html",
    "css": "css",
    "scss": "scss",
    "sass": "sass",
    "less": "less",
    "vue": "vue",
    "svelte": "svelte",
    "md": "markdown",
    "mdx": "markdown",
    "txt": "text",
    "rst": "restructuredtext",
    "sh": "shell",
    "bash": "shell",
    "zsh": "shell",
    "fish": "shell",
    "sql": "sql",
    "dockerfile": "dockerfile",
    "graphql": "graphql",
    "gql": "graphql",
    "proto": "protobuf",
    "gradle": "gradle",
    "cmake": "cmake",
    "makefile": "makefile",
}


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(url, file_path, size) of every file below a folder, whatever its name, by the store's own listing.

    Spark's readers hide names that start with _ or a dot, __init__.py among them. Names
    and sizes, and no contents, pass through the driver.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = store.makeQualified(folder).toString().rstrip("/") + "/"
    found, rows = store.listFiles(folder, True), []
    while found.hasNext():
        status = found.next()
        url = status.getPath().toString()
        rows.append((url, url.removeprefix(root), status.getLen()))
    return spark.createDataFrame(rows, "url string, file_path string, size long")


def read_folder(spark: SparkSession, path: str, repo_id: str, pattern: str = "*", max_size: int | None = None) -> DataFrame:
    """repo_id, file_path (below path), data, size of the files under a folder that all executors reach.

    data is null for files above max_size, which then aren't read.
    """

    def work(batches):
        for b in batches:
            for i in range(b.num_rows):
                url, size = b.column(0)[i].as_py(), b.column(2)[i].as_py()
                data = None
                if max_size is None or size <= max_size:
                    store, place = fs.FileSystem.from_uri(url)
                    with store.open_input_stream(place) as f:
                        data = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([repo_id]), b.column(1).slice(i, 1), pa.array([data], pa.binary()), b.column(2).slice(i, 1)], names=["repo_id", "file_path", "data", "size"])

    names = listed(spark, path).where(base_name(F.col("file_path")).rlike(glob_regex(pattern)))
    ship(spark)
    return names.mapInArrow(work, "repo_id string, file_path string, data binary, size long")


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(keep, regular expression) of each line of an ignore file, in order; the last that matches decides."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line.lstrip("!")
        anchored = "/" in line.rstrip("/")
        body = glob_regex(line.strip("/"))[1:-1]
        out.append((keep, ("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if line.endswith("/") else "(?:/.*)?$")))
    return out


def ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    out = F.lit(False)
    for keep, regex in rules:
        out = F.when(path.rlike(regex), F.lit(not keep)).otherwise(out)
    return out


def scanned(files: DataFrame, ignore: str = "", include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """files with verdict: ignored, not_included, excluded, too_large or kept, the first that holds."""
    path = F.col("file_path")
    any_of = lambda globs: F.exists(F.array(*[F.lit(glob_regex(g)) for g in globs]), lambda r: F.regexp_like(path, r)) if globs else F.lit(False)
    verdict = F.when(ignored(path, ignore_rules(ignore)), "ignored").when(F.lit(bool(include)) & ~any_of(include), "not_included").when(any_of(exclude), "excluded").when(F.col("size") > max_size, "too_large").otherwise("kept")
    return files.withColumn("verdict", verdict)


def scan_counts(scan: DataFrame) -> DataFrame:
    """total_discovered and total_excluded; ignored files are in neither."""
    return scan.agg(F.count_if(F.col("verdict") != "ignored").alias("total_discovered"), F.count_if(~F.col("verdict").isin("ignored", "kept")).alias("total_excluded"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    """By file name, else by extension in lower case, else unknown."""
    name = base_name(path)
    extension = F.lower(F.regexp_extract(name, "^.+\\.([^.]*)$", 1))
    by_name = [F.when(name == n, F.lit(v)) for n, v in BY_NAME.items()]
    by_extension = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    return F.coalesce(*by_name, F.element_at(by_extension, extension), F.lit("unknown"))


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def line_count(text: Column) -> Column:
    """Newlines, and one more for a last line without; 0 for an empty text."""
    n = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.octet_length(text) == 0, 0).when(text.endswith("\n"), n).otherwise(n + 1)


def with_metadata(files: DataFrame) -> DataFrame:
    """files with language, content, content_hash and line_count.

    Hash and lines are those of the bytes, binary or not. content is null for binary files,
    which hold a NUL; bytes of others that aren't UTF-8 become U+FFFD.
    """
    raw = F.col("data").cast("string")
    return files.withColumns({
        "language": language(F.col("file_path")), "content_hash": content_hash(F.col("data")), "line_count": line_count(raw),
        "content": F.when(~F.contains(F.col("data"), F.lit(bytearray(b"\0"))), F.make_valid_utf8(raw)),
    })


def folders(files: DataFrame) -> DataFrame:
    """(repo_id, path, name, depth): every folder above a file, the root (empty path, depth 0) included."""
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    paths = files.select("repo_id", F.explode(above).alias("path")).distinct()
    return paths.select("repo_id", "path", base_name(F.col("path")).alias("name"), F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/"))).alias("depth"))


def contains_edges(files: DataFrame) -> DataFrame:
    """(repo_id, parent, child, kind) of folders in folders and files in folders."""
    parent = lambda c: F.when(c.contains("/"), F.regexp_replace(c, "/[^/]*$", "")).otherwise("")
    inner = folders(files).where("path != ''").select("repo_id", parent(F.col("path")).alias("parent"), F.col("path").alias("child"), F.lit("Folder").alias("kind"))
    return inner.unionByName(files.select("repo_id", parent(F.col("file_path")).alias("parent"), F.col("file_path").alias("child"), F.lit("File").alias("kind")))


def upsert_contents(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Contents by repository and path: new rows take the place of old ones."""
    return stored.join(new.select("repo_id", "file_path"), ["repo_id", "file_path"], "left_anti").unionByName(new)


def delete_paths(stored: DataFrame, paths: DataFrame) -> DataFrame:
    return stored.join(paths.select("repo_id", "file_path"), ["repo_id", "file_path"], "left_anti")


def tree(files: DataFrame, language_: str | None = None, prefix: str = "") -> DataFrame:
    """(repo_id, path, kind, depth, language): folders and files in path order, of a language or below a folder only."""
    kept = files.where(under(F.col("file_path"), prefix))
    if language_ is not None:
        kept = kept.where(F.col("language") == language_)
    dirs = folders(kept).where("path != ''").select("repo_id", "path", F.lit("dir").alias("kind"), "depth", F.lit(None).cast("string").alias("language"))
    leaves = kept.select("repo_id", F.col("file_path").alias("path"), F.lit("file").alias("kind"), F.size(F.split("file_path", "/")).alias("depth"), "language")
    return dirs.unionByName(leaves).orderBy("repo_id", "path")


def nested(rows: list[dict]) -> list[dict]:
    """Rows of tree() of one repository as nested children, in path order: for what a caller shows, on the driver."""
    top: list[dict] = []
    at = {"": top}
    for r in sorted(rows, key=lambda x: x["path"]):
        parent, _, name = r["path"].rpartition("/")
        node = {"name": name, "path": r["path"], "kind": r["kind"]} | ({"children": []} if r["kind"] == "dir" else {"language": r["language"]})
        at[parent].append(node)
        if r["kind"] == "dir":
            at[r["path"]] = node["children"]
    return top
