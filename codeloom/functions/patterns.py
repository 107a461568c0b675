"""Globs, LIKE patterns, name similarity and node references."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression for whole paths: ** crosses folders, * and ? do not, {a,b} and [..] as usual."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            out.append("[" + glob[i + 1 : j].replace("!", "^", 1).replace("\\", "\\\\") + "]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def matches_glob(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


def glob_like(glob: str) -> str:
    """A glob as a LIKE pattern with backslash escapes; here * crosses folders."""
    return glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")


def under(path: Column, folder: str) -> Column:
    """Paths inside a folder; every path if the folder is empty."""
    return F.lit(True) if not folder.strip("/") else path.startswith(folder.rstrip("/") + "/")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of lower-cased names; two empty names are alike."""
    a, b = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; two empty sets share nothing."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def name_words(name: Column, least: int = 2) -> Column:
    """Distinct lower-case words of a name: parted at _ - . / and where upper case follows lower case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "[_\\-./]+", " ")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), "\\s+"), lambda w: F.length(w) >= least))


def reference(label: Column, name: Column, path: Column) -> Column:
    """Label:name:path, by which rows outside a graph name its vertices."""
    return F.concat_ws(":", label, name, path)


def referenced_name(ref: Column) -> Column:
    """The name in a reference, or the reference itself if it has no colon."""
    parts = F.split(ref, ":")
    return F.when(F.size(parts) > 1, parts[1]).otherwise(ref)


def refers_to(ref: Column, name: Column, match: str = "ref") -> Column:
    """match "exact": the reference is the name; "ref": it is, or has it between colons."""
    if match == "exact":
        return ref == name
    return (ref == name) | ref.contains(F.concat(F.lit(":"), name, F.lit(":")))


TEST_FILE = "(?i)/test/|/spec/|/__tests__/|\\.test\\.|\\.spec\\."


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)
