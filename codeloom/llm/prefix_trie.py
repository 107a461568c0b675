"""The trie of conversation prefixes, from the common prefix lengths of sorted conversations.

Conversations are sorted as sequences of turns and cut into blocks, one for each partition. lcp[p] is the number
of turns that conversation p shares with the one before it. An interval between nearest smaller values, all
values inside at least d and one equal to d, is a node of the Cartesian tree with equal values merged: the conversations that share exactly
that prefix of d turns. Nodes whose depth lies between an interval's parent's and its own have the same members and are added at the end;
a conversation's own last turns, which no neighbour shares, are a node's chain of one member.

Each block finds its intervals with a stack. One that touches a border of the block may go on there: these, the
minima from a border inward, are all that a block reports, with sums over what lies between. Their number is at
most the number of different values of lcp in the block. The driver joins the reports of all blocks with the same stack, which closes the intervals that span
blocks; each is then written by the block it starts in. Sums over an interval (saved tokens, leaves, smallest member) come
from its parts: saved_tokens adds up, over the members but the first, the lengths of the turns that the member shares with the one
before it, less those above the node.

Cases: null roles and texts are empty. Rows without conv_id belong to no conversation. A null turn goes first; rows with one
turn number go by the digest of role and text, which also makes repeated rows turns of their own. A conversation may be turnless. An empty table gives no rows.
Ids must be integers, since the base conversation is computed from them. Turns are told apart by 128 bits of SHA-256; texts don't travel, so their length doesn't matter. Other columns don't
matter. A conversation is one row of 20 bytes a turn. What reaches the driver, and goes back to each block: the minima of blocks, and for each border of blocks a digest at most.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, small_batches

#: Bytes of a turn's digest.
KEY = 16
#: Rows of one output batch, and ids in one piece of a list that spans blocks.
ROWS = 50_000
EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def rebuilt(df: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """conv_id, keys, lens: each conversation with the first h turns of its group's base in place of its own first h; h is crc32(conv_id) % most."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    key = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    turns = df.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn"), key.alias("key"), F.char_length(text).alias("n")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"], t["n"])).alias("own"))
    base = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, most - 1).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    both = own.join(base, F.col("conv_id") - F.col("conv_id") % group == F.col("base"), "left")
    lead = F.when(F.col("lead").isNull(), F.slice("own", 1, 0)).otherwise(F.slice("lead", F.lit(1), h))
    seq = both.select("conv_id", F.concat(lead, F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))).alias("seq"))
    return seq.select("conv_id", F.unhex(F.array_join(F.transform("seq", lambda t: t["key"]), "")).alias("keys"), F.transform("seq", lambda t: t["n"]).alias("lens"))


def common(a: bytes, b: bytes) -> int:
    """Turns at the beginning that two conversations share."""
    low, high = 0, min(len(a), len(b)) // KEY
    if a[: high * KEY] == b[: high * KEY]:
        return high
    while low < high:  # the first `low` are equal; `high` + 1 are not
        mid = (low + high) // 2
        if a[low * KEY : (mid + 1) * KEY] == b[low * KEY : (mid + 1) * KEY]:
            low = mid + 1
        else:
            high = mid
    return low


# --- Intervals -------------------------------------------------------------------------------
# A part is (start, members, smallest id, leaves, sum of shared lengths, that of its first member).


def joined(parts: list[tuple]) -> tuple:
    return parts[0][0], sum(p[1] for p in parts), min(p[2] for p in parts), sum(p[3] for p in parts), sum(p[4] for p in parts), parts[0][5]


class Stack:
    """Nearest smaller values on both sides of each value that is pushed between parts; intervals are closed as they end.

    left and right are the values at the borders, first and last the places there; an interval that touches a border whose value is not smaller stays open.
    nodes: [start, members, depth, low, joints, smallest, leaves, shared, parent]; low is one more than the parent's depth, joints the number of values equal to depth, parent the number of the parent's node if it is closed too, else -1.
    """

    def __init__(self, left: int, right: int, first: int, last: int):
        self.left, self.right, self.first, self.last = left, right, first, last
        self.nodes: list[list] = []
        self.stack: list[list] = []  # value, parts before its first joint, joints, parts between joints as one, children
        self.now: list = []  # parts and open values since the last joint
        self.young: list[int] = []  # closed nodes in them without a parent

    def part(self, items: list, node: list | None = None) -> None:
        self.now, self.young = items, []
        if node:
            self.young.append(len(self.nodes))
            self.nodes.append([*node, -1])

    def _close(self, after: int, place: int) -> None:
        value, before, joints, inner, children = self.stack.pop()
        start = before[0][0]
        if (start == self.first and value <= self.left) or (place == self.last and value <= self.right):
            self.now = [*before, (value, joints, inner), *self.now]
            self.young = []
            return
        whole = joined([*before, *([inner] if inner else []), *self.now])
        for c in (*children, *self.young):
            self.nodes[c][-1] = len(self.nodes)
        low = 1 + max(self.stack[-1][0] if self.stack else self.left, after)
        self.young = [len(self.nodes)]
        self.nodes.append([whole[0], whole[1], value, low, joints, whole[2], whole[3], whole[4] - whole[5], -1])
        self.now = [whole]

    def value(self, value: int, joints: int, inner: tuple | None, place: int) -> None:
        """A value after the current part; what follows it begins at place."""
        while self.stack and self.stack[-1][0] > value:
            self._close(value, place)
        if self.stack and self.stack[-1][0] == value:
            top = self.stack[-1]
            top[2] += joints
            top[3] = joined([p for p in (top[3], *self.now, inner) if p])
            top[4] += self.young
        else:
            self.stack.append([value, self.now, joints, inner, self.young])

    def end(self) -> list:
        """Close what is left; the parts and open values of the whole."""
        while self.stack:
            self._close(self.right, self.last)
        return self.now


class Block:
    """The conversations of a partition, in order, and the nodes that lie in it."""

    def __init__(self, batches, at: int, left: int, right: int):
        ids, sizes, lcp, lens, before = [], [], [], [], None
        for b in batches:
            ids.append(b.column("conv_id").to_numpy())
            lens.append(b.column("lens").flatten().to_numpy())
            for k in b.column("keys").to_pylist():
                sizes.append(len(k) // KEY)
                lcp.append(left if before is None else sizes[-1] if k == before else common(before, k))
                before = k
        self.at, self.left, self.right = at, left, right
        self.ids, self.sizes = np.concatenate(ids), np.array(sizes, dtype=np.int64)
        self.lcp = np.array([*lcp, right], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.sums = np.concatenate([[0], np.cumsum(np.concatenate(lens), dtype=np.int64)])

    def prefix(self, rows: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Lengths of the first turns of these conversations."""
        return self.sums[self.offsets[rows] + turns] - self.sums[self.offsets[rows]]

    def stack(self) -> tuple[Stack, list]:
        n = len(self.ids)
        shared = self.prefix(np.arange(n), np.maximum(self.lcp[:-1], 0)).tolist()
        leaf = (self.sizes > self.lcp[1:]).tolist()
        stack = Stack(self.left, self.right, self.at, self.at + n)
        for i, (c, size, own, s, last) in enumerate(zip(self.ids.tolist(), self.sizes.tolist(), self.lcp.tolist(), shared, leaf, strict=False)):
            p = self.at + i
            if i:
                stack.value(own, 1, None, p)
            low = 1 + max(own, int(self.lcp[i + 1]))
            stack.part([(p, 1, c, int(last), s, s)], [p, 1, size, low, 0, c, 1, 0] if size >= low else None)
        return stack, stack.end()

    def run(self, i: int) -> int:
        """How many conversations from the i-th on are equal to it, in this block."""
        j = i + 1
        while j < len(self.ids) and self.sizes[j] == self.sizes[i] == self.lcp[j]:
            j += 1
        return j - i

    def rows(self, spanning: list, inside: list, more: int, digest: str | None) -> Iterator[pa.RecordBatch]:
        """Rows of the nodes that start here. spanning: nodes over several blocks that start here, with the parent's smallest member in the last place;
        inside: (depth, start, end, smallest) of all that reach into the block; more, digest: of the list of ends that goes on in the next block."""
        stack, _ = self.stack()
        nodes = []
        for start, n, depth, low, joints, least, leaves, shared, parent in stack.nodes:
            if parent >= 0:
                above = stack.nodes[parent][5]
            else:
                above = next((s for d, a, b, s in inside if d == low - 1 and a <= start < b), None)
            nodes.append((start, n, depth, low, joints, least, leaves, shared, above))
        nodes += [tuple(x) for x in spanning]
        width = 0
        part: list[tuple] = []
        for x in nodes:
            part.append(x)
            width += x[2] - x[3] + 1
            if width >= ROWS:
                yield self._expanded(part, more, digest)
                part, width = [], 0
        if part:
            yield self._expanded(part, more, digest)

    def _expanded(self, nodes: list[tuple], more: int, digest: str | None) -> pa.RecordBatch:
        """One row for each depth from low to depth."""
        children, shas = [], []
        for start, _, depth, _, joints, *_ in nodes:
            i, ends, sha = start - self.at, 0, EMPTY
            if self.sizes[i] == depth:
                ends = self.run(i)
                if i + ends == len(self.ids) and more:
                    ends, sha = ends + more, digest
                else:
                    sha = hashlib.sha256(",".join(map(str, self.ids[i : i + ends].tolist())).encode()).hexdigest()
            children.append(joints + 1 - ends)
            shas.append(sha)
        start, n, depth, low, least, leaves, shared = (np.array([x[j] for x in nodes], dtype=np.int64) for j in (0, 1, 2, 3, 5, 6, 7))
        above = pa.array([x[8] for x in nodes], pa.int64())
        size = depth - low + 1
        node = np.repeat(np.arange(len(nodes)), size)
        at = low[node] + np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size)
        first, last = pa.array(at == low[node]), at == depth[node]
        members = pa.array(least[node])
        saved_ = shared[node] - (n[node] - 1) * self.prefix(start[node] - self.at, np.maximum(at - 1, 0))
        return pa.RecordBatch.from_arrays(
            [
                members,
                pa.array(at),
                pc.if_else(first, above.take(pa.array(node)), members),
                pa.array(n[node]),
                pa.array(np.where(last, np.array(children, dtype=np.int64)[node], 1)),
                pa.array(leaves[node]),
                pa.array(saved_),
                pa.array([shas[i] if e else EMPTY for i, e in zip(node.tolist(), last.tolist(), strict=True)]),
            ],
            names=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
        )


# --- Blocks ----------------------------------------------------------------------------------


def _per_block(blocks: DataFrame, work, schema: str) -> DataFrame:
    """work(block, batches) over the batches of each partition that has rows."""

    def run(batches):
        import itertools

        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            yield from work(int(first.column("block")[0].as_py()), itertools.chain([first], (b for b in batches if b.num_rows)))

    return blocks.mapInArrow(run, schema)


def _borders(blocks: DataFrame) -> list[dict]:
    """For each block that has rows, in order: its number, place, rows, the turns that its first conversation shares with the one before it, whether the two are equal, and how many rows are equal to its first."""

    def ends(block, batches):
        first, last, n, equal, size = None, None, 0, 0, 0
        for b in batches:
            for k in b.column("keys"):
                k = k.as_py()
                first = k if first is None else first
                equal += k == first
                last, n = k, n + 1
        yield pa.RecordBatch.from_pylist([{"block": block, "n": n, "equal": equal, "first": first, "last": last}])

    def shared(batches):
        for b in batches:
            pairs = list(zip(b.column("before").to_pylist(), b.column("first").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column("block"), b.column("n"), b.column("equal"), pa.array([-1 if x is None else common(x, y) for x, y in pairs], pa.int64()), pa.array([x == y for x, y in pairs])], names=["block", "n", "equal", "shared", "same"]
            )

    rows = _per_block(blocks, ends, "block bigint, n bigint, equal bigint, first binary, last binary")
    # One row for each block, of which there are as many as partitions.
    rows = rows.select("block", "n", "equal", "first", F.lag("last").over(Window.orderBy("block")).alias("before")).mapInArrow(shared, "block bigint, n bigint, equal bigint, shared bigint, same boolean")
    out, at = [], 0
    for r in sorted(rows.collect(), key=lambda r: r["block"]):
        out.append(r.asDict() | {"at": at})
        at += r["n"]
    return out


def _digests(blocks: DataFrame, borders: list[dict]) -> dict[int, tuple[int, str]]:
    """For each block whose last list of equal conversations goes on in the next: how many follow there, and the digest of all their ids. The list is hashed piece by piece, in order."""
    owner, more, now = {}, {}, None
    for before, b in zip(borders, borders[1:], strict=False):
        if not b["same"]:
            now = None
            continue
        if now is None or before["equal"] != before["n"]:
            now = before["block"]
        owner[b["block"]] = now
        more[now] = more.get(now, 0) + b["equal"]
    if not more:
        return {}
    place = {b["block"]: b for b in borders}

    def pieces(block, batches):
        if block not in owner and block not in more:
            return
        b, ids, keys = place[block], [], []
        for x in batches:
            ids += x.column("conv_id").to_pylist()
            keys += x.column("keys").to_pylist()
        lists = [(owner[block], ids[: b["equal"]])] if block in owner else []
        if block in more:
            start = len(keys)
            while start and keys[start - 1] == keys[-1]:
                start -= 1
            lists.append((block, ids[start:]))
        for own, some in lists:
            for i in range(0, len(some), ROWS):
                yield pa.RecordBatch.from_pylist([{"owner": own, "block": block, "piece": i, "ids": ",".join(map(str, some[i : i + ROWS]))}])

    def hashed(batches):
        own, h = None, None
        for b in batches:
            for o, ids in zip(b.column("owner").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if o != own:
                    if h:
                        yield pa.RecordBatch.from_pylist([{"owner": own, "digest": h.hexdigest()}])
                    own, h = o, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
        if h:
            yield pa.RecordBatch.from_pylist([{"owner": own, "digest": h.hexdigest()}])

    rows = _per_block(blocks, pieces, "owner bigint, block bigint, piece bigint, ids string")
    sums = rows.repartition("owner").sortWithinPartitions("owner", "block", "piece").mapInArrow(hashed, "owner bigint, digest string")
    return {r["owner"]: (more[r["owner"]], r["digest"]) for r in sums.collect()}


def _spanning(minima: dict[int, list], borders: list[dict]) -> list[list]:
    """Nodes over several blocks, from the blocks' minima; see Stack for their fields."""
    stack = Stack(-1, -1, -1, -1)
    for i, b in enumerate(borders):
        for j, x in enumerate(minima[b["block"]]):
            if len(x) == 3:
                stack.value(x[0], x[1], tuple(x[2]) if x[2] else None, -2)
            else:
                if i and not j:
                    stack.value(b["shared"], 1, None, -2)
                stack.part([tuple(x)])
    stack.end()
    return stack.nodes


def nodes(df: DataFrame) -> DataFrame:
    """The trie's nodes of a table of turns (conv_id, turn, role, text), with its conversations rebuilt."""
    spark = df.sparkSession
    small_batches(spark)
    blocks = saved(rebuilt(df).repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id").withColumn("block", F.spark_partition_id()))
    borders = _borders(blocks)
    if not borders:
        return spark.createDataFrame([], SCHEMA)
    sides = {b["block"]: (b["at"], b["shared"], after["shared"] if after else -1) for b, after in zip(borders, [*borders[1:], None], strict=True)}

    def minima(block, batches):
        yield pa.RecordBatch.from_pylist([{"block": block, "minima": json.dumps(Block(batches, *sides[block]).stack()[1])}])

    found = {r["block"]: json.loads(r["minima"]) for r in _per_block(blocks, minima, "block bigint, minima string").collect()}
    spanning = _spanning(found, borders)
    digests = _digests(blocks, borders)
    starts = np.array([b["at"] for b in borders])
    here: dict[int, tuple[list, list]] = {b["block"]: ([], []) for b in borders}
    for x in spanning:
        first, last = np.searchsorted(starts, [x[0], x[0] + x[1] - 1], side="right") - 1
        here[borders[first]["block"]][0].append([*x[:8], spanning[x[8]][5] if x[8] >= 0 else None])
        for b in borders[first : last + 1]:
            here[b["block"]][1].append((x[2], x[0], x[0] + x[1], x[5]))

    def rows(block, batches):
        yield from Block(batches, *sides[block]).rows(*here[block], *digests.get(block, (0, None)))

    return _per_block(blocks, rows, SCHEMA)
