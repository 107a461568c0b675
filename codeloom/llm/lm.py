"""Language-model scoring: hashed maximum entropy over contexts, with a class-factored softmax.

The log probability of a token is that of its class in its context plus that of the
token in its class. The class comes from a softmax over hashed features of the context
(the word before, the word before that as a skip feature, both together). The most
frequent tokens are classes of their own, all others fall into hashed classes. A hashed
class is factored further: BRANCHES subclasses by hash, each of as many again, and so on
for as many levels as the vocabulary asks for; at each level a softmax over the same
features, in a table that the node of the level is hashed into as well, chooses one. In
a last subclass, of about LEAF words, add-one counts weigh the words.

Weights are trained by rounds of distributed gradient updates: every slice of the
training documents starts from the round's weights, and the slices' changes are averaged
by their tokens, added in the order of the tasks.

A slice of documents is coded once against its own dictionary and kept in the shared
folder; counts, training and scoring read it there. A word's total count travels back
to the slices that hold the word, once for each slice, so that neither a frequent word
nor a long text makes a large group, and no vocabulary is broadcast.

Cases: a null or empty text is the end token alone; a null id counts as the empty
string for the fold. Repeated rows are documents of their own. A text of any length
lies in one slice, which grows with it. Without training documents every base score is
zero or below, as the formula gives it. Columns other than the id and the text are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, release, slices, small_batches, stored

SEED = 42
SLICE_ROWS, SLICE_BYTES = 4096, 16 << 20
#: Single-token classes (the end token among them), hashed classes, rows of the weight table.
SINGLES, HASHED, ROWS = 40, 8, 1 << 14
CLASSES = SINGLES + HASHED
#: Subclasses of a class or subclass, words of a last one, levels at most (8 * 16^2 = 2,048 last subclasses, whose counts reach the driver), rows of their table.
BRANCHES, LEAF, LEVELS, DEEP_ROWS = 16, 64, 2, 1 << 15
ROUNDS, BATCH, RATE = 2, 8192, 0.5
#: Tokens whose logits lie in a core's cache together; tokens of a table row that a step adds layer by layer, before those of frequent rows alone.
CHUNK, LAYERS = 2048, 32
FOLDS, HELD_OUT = 7, 2
#: The weight table travels in so many blocks.
BLOCKS = 64


def fold(id_col: str) -> F.Column:
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def _hashes(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w.encode(), SEED) for w in words], np.uint64).view(np.int64)


def _packed(**arrays: np.ndarray) -> bytes:
    """Arrays in one compressed Arrow stream."""
    batch = pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.large_binary()) for a in arrays.values()], names=list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


_KINDS = {"codes": np.int32, "sizes": np.int64, "ids": np.int64, "known_id": np.uint8, "folds": np.int8, "hashes": np.int64}


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(pa.py_buffer(data)).read_next_batch()
    return {n: np.frombuffer(batch.column(i)[0].as_buffer(), _KINDS[n]) for i, n in enumerate(batch.schema.names)}


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each slice of documents: slice, words (its dictionary), ns (their counts in training documents), data (codes and more), n_train.

    A document's codes end with that of the empty word, the end token.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), fold(id_col).alias("fold"))

    def gathered(batches):
        """The documents of a task in pieces of SLICE_ROWS or SLICE_BYTES: the larger a piece, the fewer of its words it shares with others."""
        held, rows_, size = [], 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                held.append(part)
                rows_ += part.num_rows
                size += part.column(1).nbytes
                if rows_ >= SLICE_ROWS or size >= SLICE_BYTES:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, rows_, size = [], 0, 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def work(batches):
        part = TaskContext.get().partitionId()
        for number, table in enumerate(gathered(batches)):
            for piece in table.to_batches():
                texts = pc.ascii_lower(pc.fill_null(piece.column(1), ""))
                # Each text gets one empty word at its end; those that splitting leaves elsewhere go.
                split = pc.ascii_split_whitespace(pc.binary_join_element_wise(texts, "", " "))
                dictionary = split.flatten().dictionary_encode()
                codes, words = dictionary.indices.to_numpy(), dictionary.dictionary.to_numpy(zero_copy_only=False).tolist()
                ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
                empty = words.index("")
                keep = codes != empty
                keep[ends - 1] = True
                codes = codes[keep]
                sizes = np.diff(np.append(0, np.cumsum(keep)[ends - 1]))
                folds = piece.column(2).to_numpy().astype(np.int8)
                train = np.repeat(folds != HELD_OUT, sizes)
                ns = np.bincount(codes[train], minlength=len(words))
                ids = piece.column(0)
                data = _packed(codes=codes.astype(np.int32), sizes=sizes.astype(np.int64), ids=pc.fill_null(ids, 0).to_numpy().astype(np.int64), known_id=pc.is_valid(ids).to_numpy(zero_copy_only=False).astype(np.uint8), folds=folds, hashes=_hashes(words))
                yield pa.RecordBatch.from_pydict({"slice": pa.array([(part << 32) + number], pa.int64()), "words": pa.array([words], pa.list_(pa.string())), "ns": pa.array([ns], pa.list_(pa.int64())), "data": pa.array([data], pa.binary()), "n_train": pa.array([int(train.sum())], pa.int64())})
        release()

    small_batches(docs.sparkSession)
    return rows.mapInArrow(work, "slice long, words array<string>, ns array<long>, data binary, n_train long")


def counts(slices_: DataFrame) -> DataFrame:
    """(slice, code, c, word): the training count of each dictionary word; word only in one row of each word."""
    each = slices_.select("slice", F.posexplode(F.arrays_zip("words", "ns")).alias("code", "x")).select("slice", "code", F.col("x.words").alias("word"), F.col("x.ns").alias("n"))
    # Totals combine before they are shuffled; the join can be split where many slices have a word.
    total = each.groupBy("word").agg(F.sum("n").alias("c"), F.min("slice").alias("first"))
    return each.join(total, "word").select("slice", "code", "c", F.when(F.col("slice") == F.col("first"), F.col("word")).alias("word"))


#: Odd multipliers that mix hashes; the upper bits index tables.
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Bits of a word's hash from which its subclasses are taken; lower ones give the class.
_FROM = 8


def levels_for(words: int) -> int:
    """Levels of subclasses that leave about LEAF words to each of the last."""
    out = 1
    while out < LEVELS and HASHED * BRANCHES**out * LEAF < words:
        out += 1
    return out


class Model:
    """Weights of the softmaxes over classes and subclasses, and the counts that weigh tokens in the last subclasses.

    leaf_tokens, leaf_words: of each last subclass, HASHED * BRANCHES^levels of them.
    """

    def __init__(self, tops: list[int], single_tokens: np.ndarray, leaf_tokens: np.ndarray, leaf_words: np.ndarray, levels: int):
        self.tops = np.array(tops, np.int64)
        self.leaf_tokens, self.leaf_words, self.levels = leaf_tokens, leaf_words, levels
        self.weights = np.zeros((ROWS, CLASSES), np.float32)
        self.deep = np.zeros((DEEP_ROWS, BRANCHES), np.float32)
        tokens = np.append(single_tokens, leaf_tokens.reshape(HASHED, -1).sum(1))
        self.bias = np.log((tokens + 1) / (tokens.sum() + CLASSES)).astype(np.float32)
        self.inner = []
        for level in range(levels):
            n = leaf_tokens.reshape(HASHED * BRANCHES**level, BRANCHES, -1).sum(2)
            self.inner.append(np.log((n + 1) / (n.sum(1, keepdims=True) + BRANCHES)).astype(np.float32))

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        """The class of each word: its own if it is one of the most frequent, else one by hash."""
        out = SINGLES + np.mod(hashes, HASHED)
        if len(self.tops):
            order = np.argsort(self.tops)
            at = np.minimum(np.searchsorted(self.tops[order], hashes), len(order) - 1)
            single = self.tops[order][at] == hashes
            out[single] = order[at[single]]
        return out

    def leaves(self, hashes: np.ndarray) -> np.ndarray:
        """The last subclass of each word, for words of hashed classes."""
        size = BRANCHES**self.levels
        return np.mod(hashes, HASHED) * size + ((hashes.view(np.uint64) >> np.uint64(_FROM)) & np.uint64(size - 1)).astype(np.int64)

    def in_leaf(self, leaves: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of a word's share in its last subclass; all unknown words of one are one more word."""
        return np.log10((c + 1) / (self.leaf_tokens[leaves] + self.leaf_words[leaves] + 1))

    def log10(self, contexts: tuple[np.ndarray, np.ndarray], classes: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """log10 probability of each token's class and subclasses in its context."""
        out = np.empty(len(classes))
        for i in range(0, len(classes), BATCH):
            f = features(*(x[i : i + BATCH] for x in contexts))
            y, leaf = classes[i : i + BATCH], leaves[i : i + BATCH]
            e, total = _exponentials(self.weights, self.bias, table_rows(f, ROWS))
            logs = np.log10(np.maximum(e[np.arange(len(y)), y] / total, 1e-30))
            inside = np.flatnonzero(y >= SINGLES)
            for level in range(self.levels):
                node, branch = self.step(leaf[inside], level)
                e, total = _exponentials(self.deep, self.inner[level][node], table_rows(f[inside] ^ _node_hash(node, level), DEEP_ROWS))
                logs[inside] += np.log10(np.maximum(e[np.arange(len(e)), branch] / total, 1e-30))
            out[i : i + BATCH] = logs
        return out

    def step(self, leaves: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(node, branch taken) of each last subclass at a level."""
        below = BRANCHES ** (self.levels - level - 1)
        return leaves // (below * BRANCHES), leaves // below % BRANCHES


def contexts_of(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the word before each token and of that before it; before a document stands the hash zero."""
    h = hashes.view(np.uint64)
    starts = np.cumsum(sizes) - sizes
    one, two = np.zeros_like(h), np.zeros_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    one[starts] = 0
    two[starts] = 0
    two[starts[sizes > 1] + 1] = 0
    return one, two


def features(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hashes of each token's features, (tokens, 3): the word before, the skipped one, both."""
    return np.stack([one * _A, (two ^ _B) * _A, (one * _B + two) * _A ^ _B], 1)


def _node_hash(node: np.ndarray, level: int) -> np.ndarray:
    return ((node.astype(np.uint64) * np.uint64(LEVELS) + np.uint64(level + 1)) * _C)[:, None]


def table_rows(f: np.ndarray, rows: int) -> np.ndarray:
    """Table rows of each feature, (3, tokens)."""
    return ((f.T * _A) >> np.uint64(64 - (rows.bit_length() - 1))).astype(np.intp, order="C")


def _exponentials(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, outcomes) in proportion to the softmax, and its sum for each token."""
    out = np.empty((f.shape[1], weights.shape[1]), np.float32)
    total, spare = np.empty(len(out), np.float32), np.empty((min(CHUNK, len(out)), out.shape[1]), np.float32)

    def logits(i: int) -> np.ndarray:
        z = out[i : i + CHUNK]
        weights.take(f[0, i : i + CHUNK], 0, z, "clip")
        for k in range(1, len(f)):
            z += weights.take(f[k, i : i + CHUNK], 0, spare[: len(z)], "clip")
        z += bias if bias.ndim == 1 else bias[i : i + CHUNK]
        return z

    for i in range(0, len(out), CHUNK):
        z, sums = logits(i), total[i : i + CHUNK]
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
            z.sum(1, out=sums)
        if not (sums.min() > 1e-30 and sums.max() < 1e30):
            # Too far from zero for exponentials as they are: the largest logit of each token becomes zero.
            z = logits(i)
            z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            z.sum(1, out=sums)
    return out, total


def _sums(g: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, how many tokens have each, sums of their gradients). Rows are numbered in 16 bits, which sort by radix."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    times = np.diff(np.append(first, len(order)))
    # The most frequent rows first, so that the rows with an r-th token are the first ones.
    by = np.argsort((len(order) - times).astype(np.uint16), kind="stable")
    first, times = first[by], times[by]
    out, spare = g.take(order[first], 0), np.empty_like(g)
    more = np.searchsorted(-times, -np.arange(LAYERS + 1))
    for r in range(1, LAYERS):
        n = more[r]
        if not n:
            break
        out[:n] += g.take(order[first[:n] + r], 0, spare[:n], "clip")
    for j in range(more[LAYERS]):
        out[j] += g.take(order[first[j] + LAYERS : first[j] + times[j]], 0).sum(0)
    return rows[first], times.astype(np.float32), out


def _step(w: np.ndarray, seen: np.ndarray, bias: np.ndarray, f: np.ndarray, y: np.ndarray) -> None:
    """One gradient step over a batch; each table row has its own step size."""
    g, total = _exponentials(w, bias, f)
    g *= np.reciprocal(total)[:, None]
    g[np.arange(len(y)), y] -= 1
    for k in range(len(f)):
        rows, times, change = _sums(g, f[k])
        seen[rows] += times
        change *= (np.float32(RATE) / np.sqrt(seen[rows] * times))[:, None]
        np.subtract(w.take(rows, 0), change, out=change)
        # A row is copied as one item.
        item = np.dtype(("V", w.shape[1] * w.itemsize))
        w.view(item)[rows, 0] = change.view(item)[:, 0]


def trained_on(model: Model, contexts: tuple[np.ndarray, np.ndarray], classes: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tables after one pass of gradient steps over these tokens."""
    w, deep = model.weights.copy(), model.deep.copy()
    seen, seen_deep = np.full(ROWS, 1.0, np.float32), np.full(DEEP_ROWS, 1.0, np.float32)
    for i in range(0, len(classes), BATCH):
        f = features(*(x[i : i + BATCH] for x in contexts))
        y, leaf = classes[i : i + BATCH], leaves[i : i + BATCH]
        _step(w, seen, model.bias, table_rows(f, ROWS), y)
        inside = np.flatnonzero(y >= SINGLES)
        for level in range(model.levels if len(inside) else 0):
            node, branch = model.step(leaf[inside], level)
            _step(deep, seen_deep, model.inner[level][node], table_rows(f[inside] ^ _node_hash(node, level), DEEP_ROWS), branch)
    return w, deep


def train(slices_: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Distributed rounds; a document's training tokens are used in one of them. The tables (5 MB) reach the driver."""
    sc = slices_.sparkSession.sparkContext
    flat = model.weights.size + model.deep.size
    for r in range(rounds):
        shared = sc.broadcast(model)

        def local(batches):
            total, tokens, m = np.zeros(flat, np.float32), 0, shared.value
            for batch in batches:
                for data in batch.column(0):
                    x = _unpacked(data.as_buffer())
                    mine = np.repeat((x["folds"] != HELD_OUT) & (np.abs(x["ids"]) // FOLDS % rounds == r), x["sizes"])
                    if not mine.any():
                        continue
                    contexts = tuple(c[mine] for c in contexts_of(x["hashes"][x["codes"]], x["sizes"]))
                    codes = x["codes"][mine]
                    w, deep = trained_on(m, contexts, m.classes(x["hashes"])[codes], m.leaves(x["hashes"])[codes])
                    total += np.concatenate([(w - m.weights).ravel(), (deep - m.deep).ravel()]) * len(codes)
                    tokens += len(codes)
            if tokens:
                # The task's mean change in half precision.
                parts = np.split((total / tokens).astype(np.float16), BLOCKS)
                yield pa.RecordBatch.from_pydict({"block": pa.array(range(BLOCKS), pa.int32()), "task": pa.array([TaskContext.get().partitionId()] * BLOCKS, pa.int32()), "tokens": pa.array([tokens] * BLOCKS, pa.int64()), "change": pa.array([p.tobytes() for p in parts], pa.binary())})

        def added(batches):
            """Sums of each block, in the order of the tasks, one row at a time."""
            sums: dict[int, list] = {}
            for batch in batches:
                for block, tokens, change in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                    got = sums.setdefault(block, [0, np.zeros(flat // BLOCKS)])
                    got[0] += tokens
                    got[1] += np.frombuffer(change.as_buffer(), np.float16).astype(float) * tokens
            if sums:
                yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "change": pa.array([(x[1] / x[0]).astype(np.float32).tobytes() for x in sums.values()], pa.binary())})

        changes = slices_.select("data").mapInArrow(local, "block int, task int, tokens long, change binary").repartition("block").sortWithinPartitions("block", "task").mapInArrow(added, "block int, change binary")
        change = np.zeros((BLOCKS, flat // BLOCKS), np.float32)
        for row in changes.collect():
            change[row["block"]] = np.frombuffer(row["change"], np.float32)
        change = change.ravel()
        model.weights += change[: model.weights.size].reshape(model.weights.shape)
        model.deep += change[model.weights.size :].reshape(model.deep.shape)
        shared.unpersist()
    return model


def scored(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    slices_ = stored(coded(docs), new_folder(spark, "lm-slices"))
    looked_up = stored(counts(slices_), new_folder(spark, "lm-counts"))
    first = looked_up.where("word is not null and c > 0")
    # The most frequent tokens, the end token always, then one row for each last subclass.
    tops = [r["h"] for r in first.where("word != ''").orderBy(F.desc("c"), "word").limit(SINGLES - 1).select(F.xxhash64("word").alias("h")).collect()]
    end = int(_hashes([""])[0])
    tops = [end, *tops]
    levels = levels_for(first.count())
    h, size = F.xxhash64("word"), BRANCHES**levels
    leaf = F.pmod(h, F.lit(HASHED)) * size + F.shiftrightunsigned(h, _FROM).bitwiseAND(F.lit(size - 1))
    kind = F.coalesce(*[F.when(h == F.lit(x), F.lit(i)) for i, x in enumerate(tops)], F.lit(SINGLES) + leaf)
    tokens, words = np.zeros(SINGLES + HASHED * size), np.zeros(SINGLES + HASHED * size)
    for r in first.groupBy(kind.cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toLocalIterator():
        tokens[r["k"]], words[r["k"]] = r["n"], r["v"]
    n, v = int(tokens.sum()), int(words.sum())
    model = train(slices_, Model(tops, tokens[:SINGLES], tokens[SINGLES:], words[SINGLES:], levels), rounds)
    shared = spark.sparkContext.broadcast(model)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for data in left.column("data"):
            x, m = _unpacked(data.as_buffer()), shared.value
            codes, sizes = x["codes"], x["sizes"]
            c = np.zeros(len(x["hashes"]), np.int64)
            c[right.column("code").to_numpy()] = right.column("c").to_numpy()
            kinds, leaves = m.classes(x["hashes"]), m.leaves(x["hashes"])
            base, inside = np.log10((c + 1) / (n + v + 1)), np.where(kinds < SINGLES, 0.0, m.in_leaf(leaves, c))
            logs = m.log10(contexts_of(x["hashes"][codes], sizes), kinds[codes], leaves[codes])
            doc = np.repeat(np.arange(len(sizes)), sizes)
            tally = lambda w: np.bincount(doc, weights=w, minlength=len(sizes))
            ids = pa.array(x["ids"], mask=x["known_id"] == 0)
            out.append(pa.table([ids, pa.array(x["folds"] == HELD_OUT), pa.array(sizes), pa.array(tally((c > 0)[codes]).astype(np.int64)), pa.array(tally(base[codes])), pa.array(tally(logs + inside[codes]))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.concat_tables(out) if out else schema.empty_table()

    both = slices_.select("slice", "data").groupBy("slice").cogroup(looked_up.select("slice", "code", "c").groupBy("slice"))
    out = both.applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
