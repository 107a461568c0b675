"""Token counts: batch encoding that returns lengths only.

Texts are encoded by the library in batches of about equal bytes. A text above
``piece_bytes`` is first split where no token can cross, so that the library never
holds the state of one huge text: with a byte-level pre-tokenizer, before white space
after anything else, and before ASCII punctuation after a letter or digit, but never
within the string of a special token. With any other tokenizer texts stay whole.

Cases: null and empty texts have no tokens. A long text without such a place, as one
word of any length, is one piece. Repeated rows are counted each; columns other than
the id and the text are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, strings, tokenizer, tokenizer_path

#: Between bytes: a place before white space or ASCII punctuation that ends a pre-token, if the character before is what it looks like.
_EDGE = re.compile(rb"(?<=[!-~\x80-\xff])(?=[ \t\n\r])|(?<=[0-9A-Za-z\x80-\xff])(?=[!-/:-@\[-`{-~])")


def _is_edge(raw: bytes, at: int, special: tuple[bytes, ...]) -> bool:
    """Whether a place that _EDGE found parts pre-tokens: the character before is no white space or, before punctuation, a letter or digit; no special token spans it."""
    start = at - 1
    while raw[start] & 0xC0 == 0x80:
        start -= 1
    before = raw[start:at].decode()
    if before.isspace() or not (raw[at : at + 1].isspace() or before.isalnum()):
        return False
    return not any(raw.find(s, max(0, at - len(s) + 1), at + len(s) - 1) >= 0 for s in special)


def pieces(text: str, size: int, special: tuple[bytes, ...] = ()) -> list[str]:
    """The text in parts of size bytes or more, each cut at the next safe place; joined, they are the text."""
    raw = text.encode()
    out, start = [], 0
    while len(raw) - start > size:
        at = next((m.start() for m in _EDGE.finditer(raw, start + size) if _is_edge(raw, m.start(), special)), None)
        if at is None:
            break
        out.append(raw[start:at].decode())
        start = at
    out.append(raw[start:].decode())
    return out


def safe_specials(path: str) -> tuple[bytes, ...] | None:
    """The strings of added tokens, if texts may be cut for this tokenizer; None if they must stay whole."""
    kind = json.loads(tokenizer(path).to_str())
    pre = kind.get("pre_tokenizer") or {}
    added = kind.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not kind.get("normalizer")
    return tuple(t["content"].encode() for t in added) if plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added) else None


def batches(lengths: list[int], limit: int) -> list[tuple[int, int]]:
    """Ranges of consecutive items of about limit in total, one item at least."""
    out, start, total = [], 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(lengths):
        out.append((start, len(lengths)))
    return out


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, piece_bytes: int = 64 << 10, batch_bytes: int = 256 << 10) -> DataFrame:
    """A row for each row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""

    special = safe_specials(path)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        model = tokenizer(path)
        texts = strings(part.column(1))
        sizes = [len(t.encode()) for t in texts]
        parts, owner, lengths = [], [], []
        for i, (t, n) in enumerate(zip(texts, sizes)):
            for p in pieces(t, piece_bytes, special) if n > piece_bytes and special is not None else (t,):
                parts.append(p)
                owner.append(i)
                lengths.append(len(p.encode()) if n > piece_bytes else n)
        counts = [0] * len(texts)
        for a, b in batches(lengths, batch_bytes):
            for i, e in zip(owner[a:b], model.encode_batch_fast(parts[a:b], add_special_tokens=False)):
                counts[i] += len(e)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_text(rows, work, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def default_path() -> str:
    return tokenizer_path("byte_bpe_50k.json")
