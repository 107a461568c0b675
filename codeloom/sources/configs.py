"""What a repository's own files say about its imports: path aliases, Go modules, Java source roots. For all repositories at once.

contents: repo_id, file_path, content. The outcomes are the side inputs of `code.imports` and `resolve`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folders that may be a Java source root, the repository itself last.
JAVA_ROOTS = ("src/main/java", "src/main/kotlin", "src/test/java", "src", "")
_TSCONFIG = "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>"


def path_aliases(contents: DataFrame) -> DataFrame:
    """(repo_id, base_url, alias, place, replacement): the paths of each repository's tsconfig.json, one row for each replacement in its order.

    Comments go first, as JSON has none: // to the end of its line, wherever it stands, then /* to */. No base is `.`; a repository whose
    file is no JSON or has no compilerOptions has no row, one without paths a row with a null alias.
    """
    plain = F.regexp_replace(F.regexp_replace("content", "(?m)//.*$", ""), "(?s)/\\*.*?\\*/", "")
    options = contents.where("file_path = 'tsconfig.json'").select("repo_id", F.from_json(plain, _TSCONFIG)["compilerOptions"].alias("o")).where("o is not null")
    base = F.when(F.coalesce(F.col("o.baseUrl"), F.lit("")) == "", ".").otherwise(F.col("o.baseUrl"))
    each = options.select("repo_id", base.alias("base_url"), F.explode_outer("o.paths").alias("alias", "r"))
    return each.select("repo_id", "base_url", "alias", F.posexplode_outer("r").alias("place", "replacement"))


def go_modules(contents: DataFrame) -> DataFrame:
    """(repo_id, module): the module path that a repository's go.mod names first."""
    named = contents.where("file_path = 'go.mod'").select("repo_id", F.regexp_extract("content", "(?m)^module\\s+(\\S+)", 1).alias("module"))
    return named.where("module != ''")


def java_roots(files: DataFrame) -> DataFrame:
    """(repo_id, root): the usual roots that hold a Java file directly; the repository's own folder if none does."""
    path = F.col("file_path")
    folder = F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    found = files.where(path.endswith(".java")).select("repo_id", folder.alias("root")).where(F.col("root").isin(*JAVA_ROOTS)).distinct()
    none = files.select("repo_id").distinct().join(found, "repo_id", "left_anti").select("repo_id", F.lit("").alias("root"))
    return found.unionByName(none)
