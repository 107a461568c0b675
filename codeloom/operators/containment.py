"""Which texts stand in which others: Aho-Corasick automata over blocks of needles, through which haystacks stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_anew, ship

#: Needles of one automaton, and haystacks that stream through one copy of it.
NEEDLES, HAYSTACKS = 100_000, 1_000_000


def found_in(automaton, text: str) -> set[str]:
    """All needles that stand in a text."""
    return {needle for _, needle in automaton.iter(text)}


def contained(haystacks: DataFrame, needles: DataFrame, needles_a_block: int = NEEDLES, haystacks_a_part: int = HAYSTACKS) -> DataFrame:
    """(haystack, needle) of all pairs in which a needle stands in a haystack; each pair once, and no other pair is made.

    haystacks has a column haystack, needles one named needle; repeats, nulls and empty needles give nothing. Needles are dealt in
    blocks by hash and haystacks in parts, every part meets every block, and a task holds one block's automaton.
    """
    import ahocorasick  # noqa: F401  fails here and not on an executor

    left = cut_anew(haystacks.where("haystack != ''").select("haystack").distinct())
    right = cut_anew(needles.where("needle != ''").select("needle").distinct())
    # Two numbers reach the driver.
    blocks, parts = -(-right.count() // needles_a_block), -(-left.count() // haystacks_a_part)
    if not blocks or not parts:
        return left.select("haystack", F.col("haystack").alias("needle")).limit(0)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    patterns = right.select(deal("needle", blocks).alias("block"), every(parts).alias("part"), F.lit(0).alias("kind"), F.col("needle").alias("text"))
    texts = left.select(every(blocks).alias("block"), deal("haystack", parts).alias("part"), F.lit(1).alias("kind"), F.col("haystack").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        key = automaton = None
        ready = False
        for b in batches:
            hay, found = [], []
            for block, part, kind, text in zip(*(b.column(c).to_pylist() for c in ("block", "part", "kind", "text")), strict=True):
                if (block, part) != key:
                    key, automaton, ready = (block, part), ahocorasick.Automaton(), False
                if kind == 0:
                    automaton.add_word(text, text)
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                if len(automaton):
                    for needle in found_in(automaton, text):
                        hay.append(text)
                        found.append(needle)
            yield pa.RecordBatch.from_arrays([pa.array(hay, pa.string()), pa.array(found, pa.string())], names=["haystack", "needle"])

    ship(haystacks.sparkSession)
    return patterns.union(texts).repartition("block", "part").sortWithinPartitions("block", "part", "kind").mapInArrow(run, "haystack string, needle string")
