"""A small MATCH language over property graphs, compiled to joins.

    MATCH (a:Function)-[e:CALLS]->(b {name: 'x'})<-[:DEFINES]-(f:File)
    WHERE a.exported = true AND (e.confidence >= 0.5 OR NOT b.name CONTAINS 'y') AND NOT EXISTS((b)-[:CALLS]->(:Class))
    RETURN DISTINCT a.name AS caller, count(*) AS n ORDER BY n DESC, caller SKIP 0 LIMIT 10

Patterns are one chain of hops; -[:CALLS*1..3]-> stands for one to three of them, no edge
twice in a path, with a row for each path. Conditions are joined by AND, OR, NOT and
parentheses; EXISTS asks for one hop from a variable of the pattern. Values are numbers,
quoted texts, true, false, null and parameters ($name). What lies outside this raises
ValueError before anything runs. Graphs are written by their DataFrames, not from here.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph

MAX_TEXT, MAX_HOPS = 10_000, 10
_NAME = r"[a-zA-Z_][a-zA-Z0-9_]*"
_VALUE = r"(?:-?\d+(?:\.\d+)?|'(?:\\.|[^'\\])*'|true|false|null|\$" + _NAME + ")"
_NODE = re.compile(rf"\(\s*(?P<var>{_NAME})?\s*(?::\s*(?P<label>{_NAME}))?\s*(?:\{{(?P<props>[^}}]*)\}})?\s*\)")
_EDGE = re.compile(rf"(?P<left><)?-(?:\[\s*(?P<var>{_NAME})?\s*(?::\s*(?P<label>{_NAME}(?:\|{_NAME})*))?\s*(?P<many>\*(?:(?P<least>\d+)?(?P<dots>\.\.)?(?P<most>\d+)?)?)?\s*\])?-(?P<right>>)?")
_PAIR = re.compile(rf"\s*({_NAME})\s*:\s*({_VALUE})\s*")
_QUOTED = re.compile(r"'(?:\\.|[^'\\])*'", re.S)
_WORD = re.compile(r"\s*(?:(?P<open>\()|(?P<close>\))|(?P<word>AND|OR|NOT|EXISTS)\b)", re.I)
_TERM = re.compile(rf"\s*(?:(?P<fn>id|label)\(\s*(?P<of>{_NAME})\s*\)|(?P<var>{_NAME})\.(?P<prop>{_NAME}))\s*(?P<op>=|<>|<=|>=|<|>|CONTAINS|STARTS WITH|ENDS WITH|IS NOT NULL|IS NULL)\s*(?P<value>{_VALUE})?", re.I)
_QUERY = re.compile(r"^\s*MATCH\s+(?P<pattern>.+?)(?:\s+WHERE\s+(?P<where>.+?))?\s+RETURN\s+(?P<distinct>DISTINCT\s+)?(?P<items>.+?)(?:\s+ORDER\s+BY\s+(?P<order>.+?))?(?:\s+SKIP\s+(?P<skip>\d+))?(?:\s+LIMIT\s+(?P<limit>\d+))?\s*;?\s*$", re.I | re.S)
_NODE_COLUMNS = ("label", "name", "file_path", "start_line", "end_line", "exported", "class_name")
_EDGE_COLUMNS = ("label", "confidence", "resolution_method", "step")


def _value(text: str, params: dict):
    if text.startswith("$"):
        if text[1:] not in params:
            raise ValueError(f"no parameter {text}")
        return params[text[1:]]
    low = text.lower()
    if low in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[low]
    if text.startswith("'"):
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    return float(text) if "." in text else int(text)


def _column(var: str, prop: str, kinds: dict[str, str]) -> Column:
    if var not in kinds:
        raise ValueError(f"unknown variable {var}")
    columns = _NODE_COLUMNS if kinds[var] == "node" else _EDGE_COLUMNS
    if prop in ("id", *columns):
        return F.col(f"{var}.{prop}")
    if kinds[var] == "edge":
        raise ValueError(f"edges have no {prop}")
    return F.col(f"{var}.props")[prop]


def _compared(c: Column, op: str, value) -> Column:
    op = op.upper()
    if op == "IS NULL":
        return c.isNull()
    if op == "IS NOT NULL":
        return c.isNotNull()
    v = F.lit(value)
    return {"=": c == v, "<>": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v, "CONTAINS": c.contains(v), "STARTS WITH": c.startswith(v), "ENDS WITH": c.endswith(v)}[op]


class _Where:
    """Reads a condition: OR binds less than AND, AND less than NOT."""

    def __init__(self, text: str, kinds: dict[str, str], params: dict, exists):
        self.text, self.at, self.kinds, self.params, self.exists = text, 0, kinds, params, exists

    def read(self) -> Column:
        out = self._either()
        if self.text[self.at :].strip():
            raise ValueError(f"can't read the condition at {self.text[self.at :][:30]!r}")
        return out

    def _next(self, word: str) -> bool:
        """Step over a word or a bracket, if it is what comes next."""
        m = _WORD.match(self.text, self.at)
        if m and m[0].strip().upper() == word:
            self.at = m.end()
            return True
        return False

    def _either(self) -> Column:
        out = self._both()
        while self._next("OR"):
            out = out | self._both()
        return out

    def _both(self) -> Column:
        out = self._one()
        while self._next("AND"):
            out = out & self._one()
        return out

    def _one(self) -> Column:
        if self._next("NOT"):
            return ~self._one()
        if self._next("EXISTS"):
            end = self.at
            while end < len(self.text) and (end == self.at or self.text[self.at : end].count("(") != self.text[self.at : end].count(")") or not self.text[self.at : end].strip()):
                end += 1
            inner, self.at = self.text[self.at : end].strip(), end
            return self.exists(inner[1:-1].strip() if inner.startswith("((") or inner.startswith("( ") else inner)
        if self._next("("):
            out = self._either()
            if not self._next(")"):
                raise ValueError("a bracket isn't closed")
            return out
        t = _TERM.match(self.text, self.at)
        if not t:
            raise ValueError(f"can't read the condition at {self.text[self.at :][:30]!r}")
        self.at = t.end()
        if not t["op"].upper().startswith("IS") and t["value"] is None:
            raise ValueError(f"no value in {t[0]!r}")
        c = _column(t["of"], t["fn"].lower(), self.kinds) if t["fn"] else _column(t["var"], t["prop"], self.kinds)
        return _compared(c, t["op"], _value(t["value"], self.params) if t["value"] else None)


def _read_pattern(pattern: str) -> list:
    """(text of the variable or empty, match) of nodes and edges in turn."""
    chain, at = [], 0
    pattern = pattern.strip()
    while at < len(pattern):
        m = (_NODE if len(chain) % 2 == 0 else _EDGE).match(pattern, at)
        if not m:
            raise ValueError(f"can't read the pattern at {pattern[at:][:30]!r}")
        chain.append((m["var"] or "", m))
        at = m.end()
        while at < len(pattern) and pattern[at].isspace():
            at += 1
    if len(chain) % 2 == 0:
        raise ValueError("the pattern ends in an edge")
    return chain


def match(graph: PropertyGraph, text: str, params: dict | None = None) -> DataFrame:
    """The rows of a MATCH query over the graph."""
    params = params or {}
    if len(text) > MAX_TEXT:
        raise ValueError("the query is too long")
    # Quoted texts become parameters, so that no word in them is read as one of the language.
    quoted: list[str] = []
    text = _QUOTED.sub(lambda m: quoted.append(m[0]) or f"$__q{len(quoted) - 1}", text)
    params = params | {f"__q{i}": _value(x, {}) for i, x in enumerate(quoted)}
    q = _QUERY.match(text)
    if not q:
        raise ValueError("the query isn't MATCH .. RETURN ..")
    chain, kinds = [], {}
    for i, (name, m) in enumerate(_read_pattern(q["pattern"])):
        var = name or f"__{i}"
        if var in kinds:
            raise ValueError(f"{var} stands twice in the pattern")
        if i % 2 and m["many"] and name:
            raise ValueError("an edge of many hops has no name")
        kinds[var] = "edge" if i % 2 else "node"
        chain.append((var, m))

    def vertices(var: str, m) -> DataFrame:
        rows = graph.nodes
        if m["label"]:
            rows = rows.where(F.col("label") == m["label"])
        have = [c for c in (*_NODE_COLUMNS, "props") if c in rows.columns]
        out = rows.select(F.col("repo_id").alias(f"{var}_repo"), F.col("id").alias(f"{var}_id"), F.struct("id", *have).alias(var))
        for p, v in _PAIR.findall(m["props"] or ""):
            out = out.where(_compared(_column(var, p, kinds), "=", _value(v, params)))
        return out

    def hops(m) -> DataFrame:
        """(repo_id, near, far, e) of the edges of one hop, in its direction or both."""
        rows = graph.edges
        if m["label"]:
            rows = rows.where(F.col("label").isin(*m["label"].split("|")))
        e = F.struct("id", *[c for c in _EDGE_COLUMNS if c in rows.columns]).alias("e")
        ways = []
        if not (m["left"] and not m["right"]):
            ways.append(rows.select("repo_id", F.col("src").alias("near"), F.col("dst").alias("far"), e))
        if not (m["right"] and not m["left"]):
            ways.append(rows.select("repo_id", F.col("dst").alias("near"), F.col("src").alias("far"), e))
        return ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])

    def paths(hop: DataFrame, m) -> DataFrame:
        """(repo_id, near, far) of each path of least to most hops, no edge twice."""
        least = int(m["least"] or 1)
        most = int(m["most"]) if m["most"] else MAX_HOPS if m["dots"] or not m["least"] else least
        if not 1 <= least <= most <= MAX_HOPS:
            raise ValueError(f"paths have 1 to {MAX_HOPS} hops")
        step = hop.select("repo_id", F.col("near").alias("far"), F.col("far").alias("next"), F.col("e.id").alias("edge"))
        grown, found = hop.select("repo_id", "near", "far", F.array("e.id").alias("edges")), []
        for n in range(1, most + 1):
            if n > 1:
                grown = grown.join(step, ["repo_id", "far"]).where(~F.array_contains("edges", F.col("edge"))).select("repo_id", "near", F.col("next").alias("far"), F.concat("edges", F.array("edge")).alias("edges"))
            if n >= least:
                found.append(grown.select("repo_id", "near", "far"))
        return reduce(DataFrame.unionByName, found)

    df = vertices(*chain[0])
    repo = f"{chain[0][0]}_repo"
    for k in range(1, len(chain), 2):
        (before, _), (var, m), (after, n) = chain[k - 1], chain[k], chain[k + 1]
        hop = hops(m)
        if m["many"]:
            pairs = paths(hop, m).select(F.col("repo_id").alias(repo), F.col("near").alias(f"{before}_id"), F.col("far").alias(f"{after}_id"))
        else:
            pairs = hop.select(F.col("repo_id").alias(repo), F.col("e").alias(var), F.col("near").alias(f"{before}_id"), F.col("far").alias(f"{after}_id"))
        df = df.join(pairs, [repo, f"{before}_id"]).join(vertices(after, n).withColumnRenamed(f"{after}_repo", repo), [repo, f"{after}_id"])
    if q["where"]:
        marks: list[DataFrame] = []

        def exists(inner: str) -> Column:
            found = _read_pattern(inner)
            names = [name for name, _ in found]
            if len(found) != 3 or sum(x in kinds for x in (names[0], names[2])) != 1 or names[1] or found[1][1]["many"]:
                raise ValueError("EXISTS takes one hop from one variable of the pattern")
            here, there = (0, 2) if names[0] in kinds else (2, 0)
            near, far = ("near", "far") if here == 0 else ("far", "near")
            if found[here][1]["label"] or found[here][1]["props"]:
                raise ValueError("say what a variable is in the pattern itself")
            flag = f"__exists{len(marks)}"
            other = vertices("__other", found[there][1]).select(F.col("__other_repo").alias("repo_id"), F.col("__other_id").alias(far))
            marks.append(hops(found[1][1]).join(other, ["repo_id", far], "left_semi").select(F.col("repo_id").alias(repo), F.col(near).alias(f"{names[here]}_id")).distinct().withColumn(flag, F.lit(True)))
            return F.coalesce(F.col(flag), F.lit(False))

        kinds["__other"] = "node"
        condition = _Where(q["where"], kinds, params, exists).read()
        for mark in marks:
            df = df.join(mark, [c for c in mark.columns if not c.startswith("__exists")], "left")
        df = df.where(condition)
    plain, counted = [], []
    for item in re.split(r",(?![^(]*\))", q["items"]):
        body, _, alias = re.sub(r"\s+AS\s+", "\0", item.strip(), flags=re.I).partition("\0")
        if alias and not re.fullmatch(_NAME, alias):
            raise ValueError(f"bad name {alias!r}")
        if m := re.fullmatch(rf"count\(\s*(DISTINCT\s+)?(\*|{_NAME})\s*\)", body, re.I):
            target = F.lit(1) if m[2] == "*" else F.col(f"{m[2]}.id")
            counted.append((F.countDistinct(target) if m[1] else F.count(target)).alias(alias or "count"))
        elif m := re.fullmatch(rf"(id|label)\(\s*({_NAME})\s*\)", body, re.I):
            plain.append(_column(m[2], m[1].lower(), kinds).alias(alias or m[1].lower()))
        elif m := re.fullmatch(rf"({_NAME})\.({_NAME})", body):
            plain.append(_column(m[1], m[2], kinds).alias(alias or m[2]))
        elif body in kinds:
            plain.append(F.col(body).alias(alias or body))
        else:
            raise ValueError(f"can't return {body!r}")
    df = df.groupBy(*plain).agg(*counted) if counted and plain else df.agg(*counted) if counted else df.select(*plain)
    if q["distinct"]:
        df = df.distinct()
    if q["order"]:
        keys = [x.strip().split() for x in q["order"].split(",")]
        df = df.orderBy(*[F.col(k[0]).desc() if len(k) > 1 and k[1].upper() == "DESC" else F.col(k[0]) for k in keys])
    if q["skip"]:
        df = df.offset(int(q["skip"]))
    return df.limit(int(q["limit"])) if q["limit"] else df
