"""Dependencies that package manifests declare: package.json, Cargo.toml, go.mod."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import base_name

#: Sections of a package.json.
NPM_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def manifests(contents: DataFrame) -> DataFrame:
    return contents.where(base_name(F.col("file_path")).isin("package.json", "Cargo.toml", "go.mod"))


def npm(contents: DataFrame) -> DataFrame:
    parts = []
    for section in NPM_SECTIONS:
        declared = F.from_json(F.get_json_object("content", f"$.{section}"), "map<string,string>")
        parts.append(contents.where(base_name(F.col("file_path")) == "package.json").select("repo_id", F.col("file_path").alias("manifest_path"), F.lit("npm").alias("ecosystem"), F.explode(declared).alias("name", "version"), F.lit(section == "devDependencies").alias("is_dev")))
    return reduce(DataFrame.unionByName, parts)


def _lines(contents: DataFrame, name: str) -> DataFrame:
    return contents.where(base_name(F.col("file_path")) == name).select("repo_id", F.col("file_path").alias("manifest_path"), F.posexplode(F.split("content", "\r?\n")).alias("n", "raw")).withColumn("line", F.regexp_replace(F.regexp_replace("raw", "\\s*(#|//).*$" if name != "Cargo.toml" else "\\s+#.*$", ""), "^\\s+|\\s+$", ""))


def cargo(contents: DataFrame) -> DataFrame:
    """name = "version", name = { version = .. } or { path = .. } or { git = .. }, and [dependencies.name] tables with a version."""
    so_far = Window.partitionBy("repo_id", "manifest_path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("line").rlike("^\\[.*\\]$"), F.regexp_extract("line", "^\\[+([^\\]]+)\\]+$", 1))
    rows = _lines(contents, "Cargo.toml").withColumn("header", header).withColumn("section", F.last("header", ignorenulls=True).over(so_far)).where("header is null")
    listed = rows.where(F.col("section").rlike("(^|\\.)(dev-|build-)?dependencies$") & F.col("line").rlike("^[A-Za-z0-9_-]+\\s*="))
    value = F.trim(F.regexp_extract("line", "^[^=]+=(.*)$", 1))
    version = F.coalesce(*[F.when(F.length(F.regexp_extract(value, p, 1)) > 0, F.regexp_extract(value, p, 1)) for p in ('^"([^"]*)"', 'version\\s*=\\s*"([^"]*)"', 'path\\s*=\\s*"([^"]*)"', 'git\\s*=\\s*"([^"]*)"')], F.lit("*"))
    a = listed.select("repo_id", "manifest_path", F.lit("cargo").alias("ecosystem"), F.regexp_extract("line", "^([A-Za-z0-9_-]+)", 1).alias("name"), version.alias("version"), F.col("section").contains("dev-").alias("is_dev"))
    tables = rows.where(F.col("section").rlike("(^|\\.)(dev-|build-)?dependencies\\.[A-Za-z0-9_-]+$"))
    own = F.when(F.col("line").startswith("version"), F.regexp_extract("line", '"([^"]*)"', 1))
    b = tables.groupBy("repo_id", "manifest_path", "section").agg(F.max(own).alias("v")).select("repo_id", "manifest_path", F.lit("cargo").alias("ecosystem"), F.regexp_extract("section", "([A-Za-z0-9_-]+)$", 1).alias("name"), F.coalesce("v", F.lit("*")).alias("version"), F.col("section").contains("dev-").alias("is_dev"))
    return a.unionByName(b)


def go(contents: DataFrame) -> DataFrame:
    """require lines and blocks."""
    so_far = Window.partitionBy("repo_id", "manifest_path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    edge = F.when(F.col("line").rlike("^require\\s*\\($"), F.lit(True)).when(F.col("line") == ")", F.lit(False))
    rows = _lines(contents, "go.mod").withColumn("edge", edge).withColumn("inside", F.coalesce(F.last("edge", ignorenulls=True).over(so_far), F.lit(False)))
    bare = F.regexp_replace("line", "^require\\s+", "")
    wanted = rows.where(F.col("edge").isNull() & (F.col("inside") | F.col("line").rlike("^require\\s+[^(]")) & bare.rlike("^\\S+\\s+v\\S+"))
    return wanted.select("repo_id", "manifest_path", F.lit("go").alias("ecosystem"), F.regexp_extract(bare, "^(\\S+)", 1).alias("name"), F.regexp_extract(bare, "^\\S+\\s+(\\S+)", 1).alias("version"), F.lit(False).alias("is_dev"))


def dependencies(contents: DataFrame) -> DataFrame:
    """repo_id, manifest_path, ecosystem, name, version, is_dev of all manifests among contents."""
    found = manifests(contents)
    return npm(found).unionByName(cargo(found)).unionByName(go(found))
