"""Grep through a stored table of trigrams: a pattern names the texts it may match before one is read.

    build(contents, folder)                         # trigrams and texts; the only reader of all texts
    grep(open_index(spark, folder), "pass(word)?=")   # the rows of `text.grep`

A pattern is translated into a condition of ANDs and ORs over trigrams that every text it matches has. Trigrams are three
code points of the text with A-Z lower-cased, and literals of patterns likewise, so one table serves both kinds of case (Java's (?i) folds A-Z only).
A pattern without such a condition (`[0-9]+`, `a.b`) reads all texts, and `searched` says so. Patterns are those of Java, read here
with Python's parser: where the two may differ (nested classes, numbered references, flags but i, m and s) there is no condition either.

Files are dealt by hash in blocks of about FILES; a row is one trigram in one block with the hashes of its files, so a condition is
evaluated for each block by unions and intersections of bounded arrays, and no list of all files with a trigram is ever in one place. Texts lie
in folders by the same hash: of a pattern with few files only their folders are read. Two files of one hash are read together.

Null texts and those of fewer than three code points have no trigram and match no condition. Repeated files are each searched.
"""

from __future__ import annotations

import math
import re
import zlib
from itertools import product
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ship
from . import text

#: Files of a block, folders of trigrams, files of a folder of texts and the most such folders.
FILES, FOLDERS, TEXTS, MOST_FOLDERS = 1024, 64, 64, 4096
#: Trigrams of texts that a block has before it is ended.
GATHERED = 1 << 20
#: The most strings that a part of a pattern is spelled out in, and the most members of a class.
STRINGS, MEMBERS = 64, 16

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = str.maketrans(_UPPER, _UPPER.lower())
#: What both dialects read alike after a backslash, punctuation aside.
_ESCAPES = set("dDwWsSbBAntrf")


class _Unlike(Exception):
    """The pattern may mean something else in Java."""


class _Part(NamedTuple):
    """What a part of a pattern matches: these strings only (None: others, too), and a condition that holds besides."""

    strings: frozenset[str] | None
    condition: object = None


def _all(parts):
    """AND of conditions: a trigram, ("and", ..), ("or", ..), or None for no condition."""
    found = sorted({p for p in parts if p is not None}, key=repr)
    return found[0] if len(found) == 1 else ("and", *found) if found else None


def _any(parts):
    found = list(parts)
    if not found or any(p is None for p in found):
        return None
    found = sorted(set(found), key=repr)
    return found[0] if len(found) == 1 else ("or", *found)


def _spelled(strings: frozenset[str]):
    """The condition that one of these strings occurs."""
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _sequence(parts) -> _Part:
    """Parts in a row: strings grow from part to part as long as they are few."""
    run, conditions, exact = frozenset([""]), [], True
    for p in parts:
        conditions.append(p.condition)
        joined = None if p.strings is None or len(run) * len(p.strings) > STRINGS else frozenset(a + b for a, b in product(run, p.strings))
        if joined is None:
            conditions.append(_spelled(run))
            exact, joined = False, p.strings if p.strings is not None else frozenset([""])
        run = joined
    if exact:
        return _Part(run, _all(conditions))
    return _Part(None, _all([*conditions, _spelled(run)]))


def _whole(part: _Part):
    return _all([part.condition, None if part.strings is None else _spelled(part.strings)])


def _read(tree) -> _Part:
    return _sequence(_one(str(op), av) for op, av in tree)


def _one(op: str, av) -> _Part:
    if op == "LITERAL":
        return _Part(frozenset([chr(av).translate(_FOLD)]))
    if op == "AT" or op == "ASSERT_NOT":
        return _Part(frozenset([""]))
    if op == "ASSERT":
        return _Part(frozenset([""]), _whole(_read(av[1])))
    if op == "IN":
        return _members(av)
    if op == "SUBPATTERN":
        return _read(av[3])
    if op == "ATOMIC_GROUP":
        return _read(av)
    if op == "BRANCH":
        arms = [_read(a) for a in av[1]]
        if all(a.strings is not None and a.condition is None for a in arms):
            strings = frozenset().union(*[a.strings for a in arms])
            if len(strings) <= STRINGS:
                return _Part(strings)
        return _Part(None, _any(map(_whole, arms)))
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, tree = av
        inner = _read(tree)
        if least == 0:
            alone = int(most) == 1 and inner.strings is not None and inner.condition is None and len(inner.strings) < STRINGS
            return _Part(inner.strings | {""}) if alone else _Part(None)
        # What comes after the least number of times may be more of it or the next part. Of very many, some say enough.
        times = min(least, STRINGS)
        again = _sequence([inner] * times)
        return again if least == most == times else _Part(None, _whole(again))
    # Any character, a negated one, a reference.
    return _Part(None)


def _members(items) -> _Part:
    found: set[str] = set()
    for op, av in items:
        codes = [av] if str(op) == "LITERAL" else range(av[0], av[1] + 1) if str(op) == "RANGE" else None
        if codes is None or len(codes) > 2 * MEMBERS:
            return _Part(None)
        found |= {chr(c).translate(_FOLD) for c in codes}
    return _Part(frozenset(found)) if len(found) <= MEMBERS else _Part(None)


def _alike(pattern: str) -> None:
    escaped = re.findall(r"\\(.)", pattern, re.S)
    if any(e.isalnum() and e not in _ESCAPES or ord(e) > 127 for e in escaped):
        raise _Unlike
    bare = re.sub(r"\\.", "-", pattern, flags=re.S)
    if re.search(r"\[\^?\]|\[[^\]]*\[|&&", bare) or any(set(f) - set("ims-") for f in re.findall(r"\(\?([A-Za-z-]+)", bare)):
        raise _Unlike


def condition(pattern: str):
    """What the trigrams of a text that the pattern matches satisfy: a trigram, ("and", ..), ("or", ..), or None if nothing is known."""
    try:
        _alike(text.checked_pattern(pattern))
        return _whole(_read(_parser.parse(pattern)))
    except _Unlike:
        return None


def trigrams_of(condition) -> set[str]:
    if condition is None:
        return set()
    return {condition} if isinstance(condition, str) else set().union(*map(trigrams_of, condition[1:]))


def holds(condition, found: set[str]) -> bool:
    """The condition for one text's trigrams, in plain Python."""
    if condition is None or isinstance(condition, str):
        return condition is None or condition in found
    return (all if condition[0] == "and" else any)(holds(c, found) for c in condition[1:])


# --- The stored table -----------------------------------------------------------------------


class Index(NamedTuple):
    grams: DataFrame
    texts: DataFrame


def _folder(gram: Column) -> Column:
    return (F.crc32(gram.cast("binary")) % FOLDERS).cast("int")


def _postings(batches):
    """(gram, block, files) of (file, block, blocks, content) in order of block and file: the trigrams of a block's files, each once.

    A block of more than GATHERED trigrams is ended between two files; its other files are a block of a number that no
    other has. So a block's lists are whole when they leave, whatever its texts' sizes.
    """
    held, size, now, parts, before = [], 0, None, 0, None

    def out():
        grams, files = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((files, grams))
        grams, files = grams[order], files[order]
        new = np.r_[True, grams[1:] != grams[:-1]]
        once = new | np.r_[True, files[1:] != files[:-1]]
        grams, files, new = grams[once], files[once], new[once]
        first = np.flatnonzero(new)
        texts = ["".join(map(chr, (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))) for g in grams[first].tolist()]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(files)], pa.int32()), pa.array(files))
        block = np.full(len(first), now[0] + parts * now[1])
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(block), lists], names=["gram", "block", "files"])

    for b in batches:
        for file, block, blocks, content in zip(*(b.column(i) for i in range(4)), strict=True):
            file, at = file.as_py(), (block.as_py(), blocks.as_py())
            if held and (at != now or (size > GATHERED and file != before)):
                yield out()
                held, size, parts = [], 0, parts + 1
            if at != now:
                now, parts = at, 0
            before = file
            codes = np.frombuffer((content.as_py() or "").encode("utf-32-le"), np.uint32).astype(np.int64)
            if len(codes) < 3:
                continue
            codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
            grams = np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])
            held.append((grams, np.full(len(grams), file)))
            size += len(grams)
    if held:
        yield out()


def build(contents: DataFrame, folder: str, files: int = FILES) -> None:
    """Write the trigrams and texts of (repo_id, file_path, content); other columns stay beside the text."""
    n = contents.count()
    blocks, parts = max(1, math.ceil(n / files)), max(1, min(MOST_FOLDERS, math.ceil(n / TEXTS)))
    file = F.xxhash64("repo_id", "file_path")
    ship(contents.sparkSession)
    # Texts are dealt by block, and a block's lists are made where its texts are and written from there: no posting is shuffled.
    each = contents.select(file.alias("file"), F.pmod(file, F.lit(blocks)).cast("long").alias("block"), F.lit(blocks).cast("long").alias("blocks"), "content").repartition("block").sortWithinPartitions("block", "file")
    rows = each.mapInArrow(_postings, "gram string, block long, files array<bigint>").withColumns({"parts": F.lit(parts), "folder": _folder(F.col("gram"))})
    rows.sortWithinPartitions("folder", "gram", "block").write.partitionBy("folder").parquet(f"{folder}/grams")
    # A full folder of texts is many tasks: texts are dealt by folder and some thousand files.
    texts = contents.withColumn("file", file).withColumn("part", F.pmod("file", F.lit(parts)).cast("int"))
    dealt = F.pmod(F.xxhash64("file"), F.lit(max(1, math.ceil(n / parts / 4096))))
    texts.repartition("part", dealt).sortWithinPartitions("part", "file").write.partitionBy("part").parquet(f"{folder}/texts")


def open_index(spark: SparkSession, folder: str) -> Index:
    return Index(spark.read.parquet(f"{folder}/grams"), spark.read.parquet(f"{folder}/texts"))


def candidates(index: Index, condition) -> DataFrame:
    """(file, part): hashes of the files whose trigrams satisfy a condition, and the folders of their texts."""
    grams = sorted(trigrams_of(condition))
    folders = sorted({zlib.crc32(g.encode()) % FOLDERS for g in grams})
    rows = index.grams.where(F.col("folder").isin(*folders) & F.col("gram").isin(*grams))
    lists = rows.groupBy("block", "parts").agg(F.map_from_entries(F.collect_list(F.struct("gram", "files"))).alias("m"))

    def files(c) -> Column:
        if isinstance(c, str):
            return F.coalesce(F.try_element_at("m", F.lit(c)), F.array().cast("array<bigint>"))
        out, *more = map(files, c[1:])
        for m in more:
            out = (F.array_intersect if c[0] == "and" else F.array_union)(out, m)
        return out

    found = lists.select(F.explode(files(condition)).alias("file"), "parts")
    return found.select("file", F.pmod("file", "parts").cast("int").alias("part"))


def texts_to_read(index: Index, pattern: str) -> DataFrame:
    """The texts that a pattern may match: all of them if it has no condition."""
    asked = condition(pattern)
    if asked is None:
        return index.texts
    found = cut(candidates(index, asked))
    # Folders of texts are at most MOST_FOLDERS numbers; they are known before the scan is planned.
    parts = [r[0] for r in found.select("part").distinct().collect()]
    return index.texts.where(F.col("part").isin(*parts)).join(found, ["part", "file"], "left_semi").select(*index.texts.columns)


def grep(index: Index, pattern: str, ignore_case: bool = False, glob: str | None = None, context: int = 0, limit: int | None = 100) -> DataFrame:
    """As `text.grep` over all texts, of which only those that the pattern's trigrams leave are read."""
    return text.grep(texts_to_read(index, pattern), pattern, ignore_case, glob, context, limit)


def searched(index: Index, pattern: str, ignore_case: bool = False) -> DataFrame:
    """One row: pattern, prefilter (trigrams, or none if all texts are read), files, files_read, files_hit (that have a matching line)."""
    read = texts_to_read(index, pattern)
    how = "none" if condition(pattern) is None else "trigrams"
    flagged = ("(?i)" if ignore_case else "") + pattern
    file_hit = F.col("content").rlike(("(?mi)" if ignore_case else "(?m)") + pattern) & F.exists(F.split("content", "\n"), lambda x: x.rlike(flagged))
    counted = read.agg(F.count("*").alias("files_read"), F.count_if(F.coalesce(file_hit, F.lit(False))).alias("files_hit"))
    total = index.texts.agg(F.count("*").alias("files")).scalar()
    return counted.select(F.lit(pattern).alias("pattern"), F.lit(how).alias("prefilter"), total.alias("files"), "files_read", "files_hit")
