"""Entry points and processes: scores, simple call paths, and what remains of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import is_test_file
from ..session import cut
from .listing import degrees

#: The first name pattern that matches gives its factor, case ignored.
NAME_FACTORS = (
    ("^handle", 2.0), ("^on[A-Z]", 2.0), ("Controller$", 2.0), ("Service$", 2.0), ("Handler$", 2.0),
    ("^process", 1.8), ("^execute", 1.8), ("^run", 1.8), ("^start", 1.8), ("^init", 1.8),
    ("^create", 1.3), ("^build", 1.3), ("^setup", 1.3),
    ("^get[A-Z]", 0.8), ("^set[A-Z]", 0.8), ("^is[A-Z]", 0.8), ("^has[A-Z]", 0.8),
    ("Helper$", 0.5), ("Util$", 0.5), ("Utils$", 0.5),
)
#: Path patterns; one below 1 decides at once, otherwise the largest holds, case ignored.
PATH_FACTORS = (
    ("/controllers?/", 3.0), ("/pages/", 3.0), ("/api[-/]route", 3.0), ("/api/.*/route\\.(ts|js)$", 3.0), ("/app/api/", 3.0),
    ("/routes?/", 2.5), ("/routers?/", 2.5), ("\\.routes?\\.(ts|js)$", 2.5),
    ("/handlers?/", 2.0),
    ("/services?/", 1.5), ("/middleware/", 1.5),
    ("/commands?/", 2.0), ("/workers?/", 2.0),
    ("/tests?/", 0.5), ("/spec/", 0.5), ("/__tests__/", 0.5), ("\\.test\\.", 0.5), ("\\.spec\\.", 0.5),
)
ENTRY_POINTS, MAX_NODES, BRANCHES, PROCESSES, LEAST_STEPS = 200, 10, 4, 75, 3
NOT_SYMBOLS = ("File", "Folder", "Community", "Process")


def name_factor(name: Column) -> Column:
    return F.coalesce(*[F.when(name.rlike("(?i)" + p), F.lit(f)) for p, f in NAME_FACTORS], F.lit(1.0))


def path_factor(path: Column) -> Column:
    # The low patterns hold in the list's order only where no earlier one is low too; all low ones are equal.
    low = [F.when(path.rlike("(?i)" + p), F.lit(f)) for p, f in PATH_FACTORS if f < 1]
    high = reduce(lambda a, b: F.greatest(a, b), [F.when(path.rlike("(?i)" + p), F.lit(f)).otherwise(1.0) for p, f in PATH_FACTORS if f >= 1])
    return F.coalesce(*low, high)


def entry_points(symbols: DataFrame, calls: DataFrame, limit: int = ENTRY_POINTS) -> DataFrame:
    """(repo_id, id, name, score) of the best callers: out / (in + 1), times 1.5 if exported, by name and by path.

    Rounded to 2 places before ordering; equal scores by id. Test files and symbols
    that call nothing are left out.
    """
    known = symbols.where(F.col("name").isNotNull() & ~F.coalesce(is_test_file(F.col("file_path")), F.lit(False)) & ~F.col("label").isin(*NOT_SYMBOLS))
    rated = known.join(degrees(calls), ["repo_id", "id"]).where("out_degree > 0")
    score = F.col("out_degree") / (F.col("in_degree") + 1) * F.when(F.coalesce("exported", F.lit(False)), 1.5).otherwise(1.0) * name_factor(F.col("name")) * F.coalesce(path_factor(F.col("file_path")), F.lit(1.0))
    return rated.select("repo_id", "id", "name", F.round(score, 2).alias("score")).orderBy(F.desc("score"), "repo_id", "id").limit(limit)


def traces(calls: DataFrame, entries: DataFrame, max_nodes: int = MAX_NODES, branches: int = BRANCHES) -> DataFrame:
    """(repo_id, entry, path): all maximal simple call paths from the entries (repo_id, id).

    A path goes on to the first branches callees, by id, that it doesn't hold yet, and ends
    at max_nodes or where there are none.
    """
    # A path holds fewer than max_nodes of a node's callees, so its choice lies among the first of them.
    rank = F.row_number().over(Window.partitionBy("repo_id", "src").orderBy("dst"))
    first = calls.where("src != dst").select("repo_id", "src", "dst").distinct().withColumn("rank", rank).where(F.col("rank") < branches + max_nodes)
    steps = cut(first.groupBy("repo_id", F.col("src").alias("tail")).agg(F.array_sort(F.collect_list("dst")).alias("next")))
    open_ = cut(entries.select("repo_id", F.col("id").alias("entry"), F.array("id").alias("path")))
    done = []
    for n in range(1, max_nodes + 1):
        if n == max_nodes:
            done.append(open_)
            break
        left = F.slice(F.array_except(F.coalesce("next", F.array().cast("array<long>")), "path"), 1, branches)
        grown = cut(open_.withColumn("tail", F.element_at("path", -1)).join(steps, ["repo_id", "tail"], "left").select("repo_id", "entry", "path", left.alias("next")))
        done.append(grown.where(F.size("next") == 0).select("repo_id", "entry", "path"))
        open_ = grown.select("repo_id", "entry", "path", F.explode("next").alias("id")).select("repo_id", "entry", F.concat("path", F.array("id")).alias("path"))
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def distinct_processes(paths: DataFrame, least: int = LEAST_STEPS, limit: int = PROCESSES) -> DataFrame:
    """(repo_id, entry, path, steps): of each entry and terminal the longest path, without those whose nodes lie within a longer one.

    Equal lengths by the path's ids. Subsets are looked for among paths that share their
    rarest node, not among all pairs.
    """
    ends = paths.withColumns({"terminal": F.element_at("path", -1), "steps": F.size("path")})
    longest = ends.groupBy("repo_id", "entry", "terminal").agg(F.min(F.struct(-F.col("steps"), F.col("path"))).alias("m")).select("repo_id", "entry", F.col("m.path").alias("path")).withColumn("steps", F.size("path"))
    longest = cut(longest)
    held = longest.select("repo_id", F.explode("path").alias("node"), "path", "steps")
    rarity = held.groupBy("repo_id", "node").agg(F.count("*").alias("n"))
    rarest = held.join(rarity, ["repo_id", "node"]).groupBy("repo_id", "path").agg(F.min(F.struct("n", "node")).alias("m")).select("repo_id", F.col("path").alias("small"), F.col("m.node").alias("node"))
    inside = rarest.join(held, ["repo_id", "node"]).where((F.size("small") < F.col("steps")) & (F.size(F.array_except("small", "path")) == 0)).select("repo_id", F.col("small").alias("path")).distinct()
    kept = longest.join(inside, ["repo_id", "path"], "left_anti").where(F.col("steps") >= least)
    return kept.select("repo_id", "entry", "path", "steps").orderBy(F.desc("steps"), "repo_id", "path").limit(limit)


def typed_processes(processes: DataFrame, names: DataFrame, membership: DataFrame) -> DataFrame:
    """processes with process_type (cross_community if their nodes lie in several communities), label and names of both ends."""
    each = processes.select("repo_id", "path", F.explode("path").alias("id")).join(membership.select("repo_id", "id", "community"), ["repo_id", "id"], "left")
    kinds = each.groupBy("repo_id", "path").agg(F.countDistinct("community").alias("communities"))
    name = names.select("repo_id", "id", "name")
    out = processes.join(kinds, ["repo_id", "path"]).withColumn("terminal", F.element_at("path", -1))
    out = out.join(name.select("repo_id", F.col("id").alias("entry"), F.col("name").alias("entry_name")), ["repo_id", "entry"], "left").join(name.select("repo_id", F.col("id").alias("terminal"), F.col("name").alias("terminal_name")), ["repo_id", "terminal"], "left")
    return out.select("repo_id", "entry", "path", "steps", F.when(F.col("communities") > 1, "cross_community").otherwise("intra_community").alias("process_type"), F.concat_ws(" → ", "entry_name", "terminal_name").alias("label"))


def process_steps(processes: DataFrame) -> DataFrame:
    """STEP_IN_PROCESS rows of processes: (repo_id, path, id, step), steps from 1."""
    return processes.select("repo_id", "path", F.posexplode("path").alias("pos", "id")).select("repo_id", "path", "id", (F.col("pos") + 1).alias("step"))
