"""A stored inverted index of file contents, read by term and block.

    build(contents, folder)                    # tokens, positions and lengths; the only reader of texts
    search(open_index(spark, folder), "a b")   # the best files by BM25, the scores of `text.scored`

Files are dealt by hash in blocks of about DOCS, the same for all terms. A row is one term in one block: how many files have it,
the most occurrences and the shortest file among them, and the files with length, occurrences and positions. The empty
term has every file, so counts and lengths of all files are read from it. Rows lie in folders by a hash of the term, sorted by
term and block: a query reads its terms' folders and, of the files there, the row groups that may hold them.

A search reads the numbers of its terms' rows first. With the most occurrences and the shortest file a block's best score is bounded;
the files of the FIRST blocks of the highest bounds are scored, then those of the blocks whose bound reaches the last place of that
list. No other block can have a file of the result, so the rest is never read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .text import B, K1, tokens

#: Files of a block, folders of terms, and blocks that are scored before a bound is known.
DOCS, FOLDERS, FIRST = 1024, 64, 4
#: Tokens that a block has before it is ended.
GATHERED = 1 << 22


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("repo_id", "file_path"), F.lit(blocks)).cast("long").alias("block")


_FILE = pa.struct([("repo_id", pa.string()), ("file_path", pa.string()), ("len", pa.int32()), ("tf", pa.int32()), ("positions", pa.list_(pa.int32()))])
_ROW = "term string, block long, n long, most int, shortest int, lengths long, files array<struct<repo_id:string,file_path:string,len:int,tf:int,positions:array<int>>>"


def _lists(repos, paths, texts, block: int) -> pa.RecordBatch:
    """The rows of one block: files' tokens sorted by term, file and place, the empty term at place -1 of each file."""
    lens = np.array([len(t) for t in texts], np.int32)
    empty = pa.array([""] * len(texts), pa.string())
    words = pa.concat_arrays([empty, *[t.cast(pa.string()) for t in texts]]).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64)
    file = np.r_[np.arange(len(texts)), np.repeat(np.arange(len(texts)), lens)]
    place = np.r_[np.full(len(texts), -1), np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)]
    order = np.argsort(codes * len(texts) + file, kind="stable")
    codes, file, place = codes[order], file[order], place[order].astype(np.int32)
    each = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (file[1:] != file[:-1])])
    tf = np.diff(np.r_[each, len(codes)]).astype(np.int32)
    codes, file = codes[each], file[each]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    which, at = pa.array(file), lens[file]
    positions = pa.ListArray.from_arrays(pa.array(np.r_[each, len(place)], pa.int32()), pa.array(place))
    files = pa.StructArray.from_arrays([pa.array(repos, pa.string()).take(which), pa.array(paths, pa.string()).take(which), pa.array(at), pa.array(tf), positions], fields=list(_FILE))
    columns = [
        words.dictionary.take(pa.array(codes[first])), pa.array(np.full(len(first), block, np.int64)), pa.array(np.diff(np.r_[first, len(codes)]).astype(np.int64)), pa.array(np.maximum.reduceat(tf, first)),
        pa.array(np.minimum.reduceat(at, first)), pa.array(np.add.reduceat(at.astype(np.int64), first)), pa.ListArray.from_arrays(pa.array(np.r_[first, len(codes)], pa.int32()), files),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["term", "block", "n", "most", "shortest", "lengths", "files"])


def _postings(batches):
    """Rows of (repo_id, file_path, block, blocks, t) in order of block. A block of more than GATHERED tokens is ended between two names; its other files are a block of a number that no other has."""
    held, size, now, parts, before = [], 0, None, 0, None
    for b in batches:
        for i, (repo, path, block, blocks) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)):
            at = (block, blocks)
            if held and (at != now or (size > GATHERED and (repo, path) != before)):
                yield _lists(*zip(*held, strict=True), now[0] + parts * now[1])
                held, size, parts = [], 0, parts + 1
            if at != now:
                now, parts = at, 0
            before = (repo, path)
            held.append((repo, path, b.column("t")[i].values))
            size += len(held[-1][2])
    if held:
        yield _lists(*zip(*held, strict=True), now[0] + parts * now[1])


def build(contents: DataFrame, folder: str, docs: int = DOCS) -> None:
    """Write the index of (repo_id, file_path, content); a null content is empty. A file that comes twice is two files of one name."""
    blocks = max(1, math.ceil(contents.count() / docs))
    ship(contents.sparkSession)
    # Texts are dealt by block, and a block's rows are made where its texts are and written from there: no posting is shuffled.
    texts = contents.select("repo_id", "file_path", _block(blocks), "content").repartition("block").sortWithinPartitions("block", "repo_id", "file_path")
    each = texts.select("repo_id", "file_path", "block", F.lit(blocks).cast("long").alias("blocks"), F.coalesce(tokens(F.col("content")), F.array().cast("array<string>")).alias("t"))
    rows = each.mapInArrow(_postings, _ROW).withColumn("folder", _folder(F.col("term")))
    rows.sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(folder)


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def _rows(index: DataFrame, terms: list[str]) -> DataFrame:
    """Rows of some terms; the folders are numbers before the scan is planned."""
    spark = index.sparkSession
    folders = sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_folder(F.col("term"))).collect()})
    return index.where(F.col("folder").isin(*folders) & F.col("term").isin(*terms))


def _words(query: str) -> list[str]:
    return sorted(set(re.findall(r"\w+", query.lower())))


class _Query:
    """A query's words with the numbers of the index: a row for each word reaches the driver."""

    def __init__(self, index: DataFrame, query: str):
        self.index, self.words = index, _words(query)
        found = {r["term"]: r for r in _rows(index, ["", *self.words]).groupBy("term").agg(F.sum("n").alias("n"), F.sum("lengths").alias("lengths")).collect()}
        self.possible = bool(self.words) and all(w in found for w in self.words)
        if self.possible:
            self.docs, self.mean = found[""]["n"], found[""]["lengths"] / found[""]["n"]
            self.idf = [math.log(1 + (self.docs - found[w]["n"] + 0.5) / (found[w]["n"] + 0.5)) for w in self.words]

    def weight(self, i: int, tf: Column, length: Column) -> Column:
        return F.lit(self.idf[i]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(self.mean)))

    def bounds(self) -> DataFrame:
        """(block, bound) of the blocks in which every word occurs; files' lists aren't read."""
        bound = F.lit(0.0)
        for i, w in enumerate(self.words):
            bound = F.when(F.col("term") == w, self.weight(i, F.col("most"), F.col("shortest"))).otherwise(bound)
        return _rows(self.index, self.words).select("block", bound.alias("b")).groupBy("block").agg(F.count("*").alias("k"), F.sum("b").alias("bound")).where(F.col("k") == len(self.words)).select("block", "bound")

    def files(self, rows: DataFrame) -> DataFrame:
        """(repo_id, file_path, score) of the files in these rows that have every word."""
        one = rows.select("term", F.explode("files").alias("f")).select("term", "f.*")
        tf = [F.max(F.when(F.col("term") == w, F.col("tf"))).alias(f"tf{i}") for i, w in enumerate(self.words)]
        each = one.groupBy("repo_id", "file_path", "len").agg(*tf)
        score = F.lit(0.0)
        for i in range(len(self.words)):
            each = each.where(F.col(f"tf{i}").isNotNull())
            score = score + self.weight(i, F.col(f"tf{i}"), F.col("len"))
        return each.select("repo_id", "file_path", score.alias("score"))


def _none(index: DataFrame) -> DataFrame:
    return index.sparkSession.createDataFrame([], "repo_id string, file_path string, score double")


def search(index: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The best files by score rounded to 4 places, equal ones by path; as text.keyword_search, without a text."""
    q = _Query(index, query)
    if not q.possible:
        return _none(index)
    top = lambda df: df.withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), "repo_id", "file_path").limit(min(limit, 100))
    bounds = q.bounds()
    first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
    rows = _rows(index, q.words)
    best = top(q.files(rows.where(F.col("block").isin(*first)))).collect()
    # Scores are compared after rounding, so a bound a ten-thousandth below may still tie.
    least = best[-1]["score"] - 1e-4 if len(best) == min(limit, 100) else -1.0
    more = bounds.where((F.col("bound") >= least) & ~F.col("block").isin(*first)).select("block")
    found = q.files(rows.join(more, "block", "left_semi"))
    return top(found.unionByName(index.sparkSession.createDataFrame(best, "repo_id string, file_path string, score double")))


def total(index: DataFrame, query: str) -> DataFrame:
    """How many files have every word, from their terms' rows alone."""
    q = _Query(index, query)
    found = q.files(_rows(index, q.words).join(q.bounds().select("block"), "block", "left_semi")) if q.possible else _none(index)
    return found.agg(F.count("*").alias("total"))


def phrase(index: DataFrame, words: str) -> DataFrame:
    """(repo_id, file_path, times): files in which the words stand in a row, and how often, by their positions."""
    each = re.findall(r"\w+", words.lower())
    none = index.sparkSession.createDataFrame([], "repo_id string, file_path string, times int")
    if not each:
        return none
    one = _rows(index, sorted(set(each))).select("term", F.explode("files").alias("f")).select("term", "f.repo_id", "f.file_path", "f.positions")
    # Where a phrase would begin, by each of its words; it does where all agree.
    moved = lambda i: F.transform("positions", lambda p: p - i)
    starts = one.groupBy("repo_id", "file_path").agg(*[F.max(F.when(F.col("term") == w, moved(i))).alias(f"p{i}") for i, w in enumerate(each)])
    common = F.col("p0")
    for i in range(1, len(each)):
        common = F.array_intersect(common, F.col(f"p{i}"))
    return starts.select("repo_id", "file_path", F.size(common).alias("times")).where("times > 0")
