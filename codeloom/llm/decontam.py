"""Benchmark decontamination with a generalised suffix automaton.

The normalised items of a benchmark become one automaton over words. The words of
each document stream through it; at every word the state tells the longest match
that ends there. A match of ``window`` words or more, or of a whole shorter item,
marks the words it covers. Marked spans are removed, and a document that is marked
beyond ``max_coverage`` of its words is dropped.

A benchmark of any size is read in blocks, each an automaton. The driver holds one
block at a time; each travels by itself, and a worker holds two automata at once. With
more blocks than one, documents are gathered in larger pieces, and each piece goes
through all blocks, so a document is read once and nothing is shuffled.

Cases: a null or empty text has no words and stays clean. An item without words
marks nothing; an item whose id is null marks words but is neither counted nor
listed. Rows that repeat give a row each; items that repeat count once by id. Texts of
any length are scanned whole. Columns travel under a prefix, so their names may clash
with ours. An empty benchmark leaves every document clean; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices, small_batches, utf8

#: The automaton of so many words takes about 100 MB in a Python worker. A larger
#: benchmark is dealt over several automata, and documents stream through each.
BLOCK_WORDS = 200_000
#: Automata that a Python process keeps, and the bytes of text that go through several blocks together.
KEPT, GATHERED = 2, 32 << 20

_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of A-Z lower-cased UTF-8: what remains between ASCII characters other than digits and letters."""
    return text.translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences; no match crosses two of them."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window, self.next, self.link, self.length = window, [{}], [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        #: The state that holds the last `window` words of a state's strings.
        self.full = [0] * len(self.next)
        for s in order:
            if self.length[s] >= window:
                up = self.link[s]
                self.full[s] = s if self.length[up] < window else self.full[up]
        self.owners: dict[int, set] = {}
        short: dict[int, list] = {}
        for item, words in items:
            s = 0
            for i, w in enumerate(words):
                s = self.next[s][w]
                if i >= window and self.length[self.link[s]] >= window:
                    s = self.link[s]
                if i + 1 >= window:
                    self.owners.setdefault(s, set()).add(item)
            if 0 < len(words) < window:
                short.setdefault(s, []).append((len(words), item))
        #: Whole short items that end where a state ends, those of its suffixes included.
        self.short: dict[int, list] = {}
        for s in order if short else ():
            if found := short.get(s, []) + self.short.get(self.link[s], []):
                self.short[s] = found

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: bytes, q: int) -> int:
        """A state for the strings of q that are p's strings with w, and shorter."""
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Marked spans of words, disjoint and in order, and the items whose windows occur."""
        nxt, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        spans: list[list[int]] = []
        found: set = set()
        states: set[int] = set()
        s = n = 0
        for i, w in enumerate(words):
            go = nxt[s]
            if w in go:
                s = go[w]
                n += 1
            else:
                while s != -1 and w not in nxt[s]:
                    s = link[s]
                if s == -1:
                    s = n = 0
                    continue
                n = length[s] + 1
                s = nxt[s][w]
            if n >= window:
                states.add(self.full[s])
                start = i - window + 1
            elif not short:
                continue
            else:
                start = i + 1
            if s in short:
                for m, item in short[s]:
                    if m <= n:
                        found.add(item)
                        start = min(start, i - m + 1)
            if start <= i:
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
        for x in states:
            found |= self.owners[x]
        return [(a, b) for a, b in spans], found


_BUILT: dict[str, Automaton] = {}


class Block:
    """Items of a benchmark on their way to the workers, where they become an automaton."""

    def __init__(self, sc, items: list[tuple[object, bytes]], window: int):
        self.shared, self.window = sc.broadcast(items), window
        self.key = hashlib.sha256(repr((window, items)).encode()).hexdigest()

    def automaton(self) -> Automaton:
        """Built in this Python process or kept from before; the last KEPT ones are."""
        if self.key not in _BUILT:
            while len(_BUILT) >= KEPT:
                del _BUILT[next(iter(_BUILT))]
            _BUILT[self.key] = Automaton([(i, words_of(t)) for i, t in self.shared.value], self.window)
            # The items themselves lie on the executor's disk and can be read there again.
            if getattr(self.shared, "_path", None):
                self.shared.__dict__.pop("_value", None)
        return _BUILT[self.key]


def blocks(benchmark: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> list[Block]:
    """The items in blocks of at most block_words words, or one longer item. One block at a time is in the driver."""
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where(F.length("t") > 0)
    out: list[Block] = []
    held, words = [], 0
    for r in rows.toLocalIterator():
        text = r["t"].encode()
        n = len(words_of(text))
        if held and words + n > block_words:
            out.append(Block(sc, held, window))
            held, words = [], 0
        held.append((r["i"], text))
        words += n
    return [*out, Block(sc, held, window)] if held else out


def marked(texts: list[bytes], parts: list[Block]) -> tuple[list[int], list[list[list[int]]], list[set]]:
    """Of each text: its words, its marked spans of words, disjoint and in order, and the items whose windows occur."""
    counts = [0] * len(texts)
    spans: list[list[list[int]]] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    # Automata kept from before come first.
    for part in sorted(parts, key=lambda x: x.key not in _BUILT):
        auto = part.automaton()
        for i, t in enumerate(texts):
            found, owners = auto.scan(words_of(t))
            if found:
                spans[i] = merged(spans[i], found)
                items[i] |= owners
    for i, t in enumerate(texts):
        counts[i] = len(words_of(t))
    return counts, spans, items


def merged(a: list[list[int]], b: list) -> list[list[int]]:
    """Spans of two lists as disjoint ones; those that touch are one."""
    out: list[list[int]] = []
    for x, y in sorted([*a, *map(list, b)]):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def gathered(batches, column: str, parts: list[Block]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches or, for several blocks, larger pieces of them."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, column):
            held.append(part)
            size += part.nbytes
            if len(parts) < 2 or size >= GATHERED:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document: id, n_words, spans (array of start and end word), items (sorted ids as strings)."""
    parts = blocks(benchmark, window, block_words=block_words)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select("id").withColumns({"n_words": F.lit(0).cast("long"), "spans": F.expr("cast(array() as array<array<int>>)"), "items": F.expr("cast(array() as array<string>)")}).schema

    def work(batches):
        for part in gathered(batches, "text", parts):
            counts, spans, items = marked(utf8(part.column("text")), parts)
            listed = [sorted(str(x) for x in found if x is not None) for found in items]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(listed, pa.list_(pa.string()))], names=["id", "n_words", "spans", "items"])
        release()

    small_batches(docs.sparkSession)
    return rows.mapInArrow(work, schema)


def hit_words() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x[1] - x[0]).cast("long"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = scan(docs.select("doc_id", "text"), benchmark, window)
    return out.select(F.col("id").alias("doc_id"), "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def cut(text: str, spans: list[list[int]]) -> str:
    """The text without the characters from the first to the last word of each span; blanks left side by side become one."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    out.append(text[done:])
    return re.sub(r" {2,}", " ", "".join(x for x in out)).strip()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, all columns, without the marked spans; documents marked beyond max_coverage go. n_chars, if there is one, follows the text.

    Words that a cut brings together may be a window themselves, so what was cut is
    scanned again until nothing is marked.
    """
    parts = blocks(benchmark, window, block_words=block_words)
    names = [f"__{c}" for c in docs.columns]
    rows = docs.select(*[(F.col(c).cast("string") if c == "text" else F.col(c)).alias(n) for c, n in zip(docs.columns, names)])

    def work(batches):
        for part in gathered(batches, "__text", parts):
            texts = part.column("__text").to_pylist()
            counts, spans, _ = marked(utf8(part.column("__text")), parts)
            kept = [sum(b - a for a, b in x) <= max_coverage * n for x, n in zip(spans, counts)]
            open_ = {i: x for i, (x, k) in enumerate(zip(spans, kept)) if x and k}
            while open_:
                for i, x in open_.items():
                    texts[i] = cut(texts[i], x)
                again = list(open_)
                open_ = {i: x for i, x in zip(again, marked([texts[i].encode() for i in again], parts)[1]) if x}
            columns = [pa.array(texts, pa.string()) if n == "__text" else part.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(kept))
        release()

    small_batches(docs.sparkSession)
    out = rows.mapInArrow(work, rows.schema).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
