"""Text search over file contents: grep, keyword search, snippets, and fusion with vector search.

contents: repo_id, file_path, content. Tokens are runs of letters, digits and _ of the
lower-cased text. Keyword ranking is BM25 as published, with k1 1.2, b 0.75 and the
idf ln(1 + (N - n + 0.5) / (n + 0.5)); all words of a query must occur.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import glob_like
from ..session import cut

TOKEN = "[\\p{L}\\p{N}_]+"
K1, B = 1.2, 0.75
RRF_K = 60


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def postings(contents: DataFrame) -> DataFrame:
    """(repo_id, file_path, term, tf, positions): an inverted index of whole texts."""
    each = contents.select("repo_id", "file_path", F.posexplode(tokens(F.col("content"))).alias("pos", "term"))
    return each.groupBy("repo_id", "file_path", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def checked_pattern(pattern: str) -> str:
    """The pattern, if it compiles."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"bad pattern: {e}") from None
    return pattern


def grep_files(contents: DataFrame, pattern: str, ignore_case: bool = False, glob: str | None = None) -> DataFrame:
    """The files a pattern or glob leaves; * in the glob crosses folders. ^ and $ are those of lines."""
    out = contents.where(F.col("content").rlike(("(?mi)" if ignore_case else "(?m)") + checked_pattern(pattern)))
    return out if glob is None else out.where(F.col("file_path").like(glob_like(glob)))


def grep(contents: DataFrame, pattern: str, ignore_case: bool = False, glob: str | None = None, context: int = 0, limit: int | None = 100) -> DataFrame:
    """(repo_id, file_path, line_number, line, before, after): a row for each matching line, numbers from 1.

    The pattern filters files before lines are made. context lines on both sides come
    from the line array itself. The limit, 500 at most, takes rows in order of path and line.
    """
    context = max(0, min(context, 10))
    flagged = ("(?i)" if ignore_case else "") + checked_pattern(pattern)
    lines = grep_files(contents, pattern, ignore_case, glob).withColumn("lines", F.split("content", "\n"))
    # Only the numbers of matching lines are exploded.
    hits = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(flagged), i + 1)), lambda i: i.isNotNull())
    rows = lines.select("repo_id", "file_path", "lines", F.explode(hits).alias("line_number"))
    n = F.col("line_number")
    start = F.greatest(n - context, F.lit(1))
    out = rows.select(
        "repo_id", "file_path", n, F.element_at("lines", n).alias("line"), F.slice("lines", start, n - start).alias("before"), F.slice("lines", n + 1, F.lit(context)).alias("after")
    )
    return out if limit is None else out.orderBy("repo_id", "file_path", "line_number").limit(min(limit, 500))


def line_slice(content: Column, first: int | None = None, last: int | None = None) -> Column:
    """Lines first..last, from 1, both included and clamped; the whole text if first is above last."""
    if first is None and last is None:
        return content
    first = max(1, first or 1)
    if last is not None and first > last:
        return content
    lines = F.split(content, "\n")
    return F.array_join(F.slice(lines, first, F.size(lines) if last is None else F.lit(last - first + 1)), "\n")


def scored(contents: DataFrame, query: str) -> DataFrame:
    """(repo_id, file_path, score) of the files that have every word of the query.

    One scan counts, in each text, its length and its occurrences of the few query
    words, and these numbers are kept; what is summed over all texts is one row.
    """
    words = sorted(set(re.findall(r"\w+", query.lower())))
    if not words:
        return contents.select("repo_id", "file_path", F.lit(0.0).alias("score")).limit(0)
    toks = contents.select("repo_id", "file_path", F.coalesce(tokens(F.col("content")), F.array().cast("array<string>")).alias("t"))
    count = lambda w: F.size(F.filter("t", lambda x: x == w))
    tf = cut(toks.select("repo_id", "file_path", F.size("t").alias("len"), *[count(w).alias(f"tf{i}") for i, w in enumerate(words)]))
    total = tf.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(words))])
    hit = tf
    for i in range(len(words)):
        hit = hit.where(F.col(f"tf{i}") > 0)
    all_ = total.select(F.struct("*")).scalar()
    score = F.lit(0.0)
    for i in range(len(words)):
        f, df = F.col(f"tf{i}"), all_[f"df{i}"]
        idf = F.log(1 + (all_["n"] - df + 0.5) / (df + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / all_["avg_len"]))
    return hit.select("repo_id", "file_path", score.alias("score"))


def keyword_search(contents: DataFrame, query: str, limit: int = 20, languages: DataFrame | None = None) -> DataFrame:
    """The best files by score, equal scores by path, with their language if languages (repo_id, file_path, language) are given."""
    out = scored(contents, query).withColumn("score", F.round("score", 4))
    top = out.orderBy(F.desc("score"), "repo_id", "file_path").limit(min(limit, 100))
    return top if languages is None else top.join(languages, ["repo_id", "file_path"], "left")


def keyword_total(contents: DataFrame, query: str) -> DataFrame:
    return scored(contents, query).agg(F.count("*").alias("total"))


def snippets(content: Column, query: str, fragments: int = 3, words: int = 35) -> Column:
    """Up to so many fragments around query words, the words between ** and the fragments joined by ' ... '."""
    wanted = sorted(set(re.findall(r"\w+", query.lower())))
    marked = "(?i)(?<![\\p{L}\\p{N}_])(" + "|".join(map(re.escape, wanted)) + ")(?![\\p{L}\\p{N}_])"
    toks = F.split(F.trim(F.regexp_replace(content, "\\s+", " ")), " ")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(toks) - 1) / words), F.lit(0))), lambda i: F.array_join(F.slice(toks, i * words + 1, F.lit(words)), " "))
    hits = F.slice(F.filter(blocks, lambda b: b.rlike(marked)), 1, fragments)
    return F.regexp_replace(F.array_join(hits, " ... "), marked, "**$1**")


def reciprocal_ranks(keyword: DataFrame, semantic: DataFrame, limit: int = 20, k: int = RRF_K) -> DataFrame:
    """Fusion of ranked lists: keyword (file_path, rank) and semantic (file_path, rank, symbol).

    Each hit adds 1 / (k + rank) to its file. A file with several semantic hits gets all of
    them; its semantic_rank is the worst and its symbol that of the best. Rounded to 4
    places; equal scores: keyword hits first by rank, then by semantic rank.
    """
    sem = semantic.groupBy("file_path").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("s"), F.max("rank").alias("semantic_rank"), F.min_by("symbol", "rank").alias("symbol"), F.min("rank").alias("first_rank"))
    key = keyword.select("file_path", F.col("rank").alias("keyword_rank"))
    both = key.join(sem, "file_path", "full_outer")
    score = F.coalesce(1 / (F.lit(k) + F.col("keyword_rank")), F.lit(0.0)) + F.coalesce("s", F.lit(0.0))
    out = both.select("file_path", F.round(score, 4).alias("score"), "keyword_rank", "semantic_rank", "symbol", "first_rank")
    return out.orderBy(F.desc("score"), F.col("keyword_rank").asc_nulls_last(), "first_rank", "file_path").limit(limit).drop("first_rank")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows of a short list with their rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
