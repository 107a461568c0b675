"""Token ids of whole texts, as the library gives them, with each distinct chunk encoded once.

The vocabulary meant here lower-cases, drops white space and ends each word with a
token of its own kind. Neither its normaliser nor a special token crosses white
space, so the ids of a text are those of its chunks between ASCII white space, in
order. Arrow splits a slice of texts into its distinct chunks; only those that were
not met before are encoded. Among them, plain words go to the library joined by
spaces, as one text; word ends divide the result. The memory held is bounded: the
table of chunks is emptied when it is full. A tokenizer of any other kind is given whole
texts.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import tokenizer

#: Chunks held at once in a Python worker (about 100 MB), and the longest that is worth holding.
HELD_CHUNKS, HELD_CHARS = 400_000, 64
#: A plain word is one word to the pre-tokenizer and alike before and after normalisation;
#: the marks after it are one more. Anything else is encoded as a chunk of its own.
_KINDS = re.compile("^(?:([a-zß-öø-ÿ]{1,64})([.,;:!?]*)|(.*))$", re.M)
_JOINED = 2048


def _by_chunks(kind: dict) -> bool:
    """Whether a tokenizer's description is of the kind meant here: lower-cased, parted at white space, which it drops, words with an end of their own."""
    steps = (kind.get("normalizer") or {}).get("normalizers") or []
    cuts = (kind.get("pre_tokenizer") or {}).get("pretokenizers") or []
    first = cuts[0] if cuts else {}
    blanks = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in steps)
    parted = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and all(not c.get("use_regex") and not c.get("add_prefix_space") for c in cuts[1:])
    marked = all(t["content"].startswith("<|") and not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in kind.get("added_tokens") or [])
    return bool(kind["model"].get("end_of_word_suffix")) and any(s["type"] == "Lowercase" for s in steps) and blanks and bool(parted) and marked and not kind.get("post_processor")


class ChunkEncoder:
    """encode() gives unsigned 32-bit ids, without special tokens."""

    def __init__(self, path: str):
        self.path = path
        self.known: dict[str, bytes] = {"": b""}
        self.tails: dict[str, bytes] = {"": b""}
        kind = json.loads(tokenizer(path).to_str())
        vocabulary = kind["model"]
        self.chunked = _by_chunks(kind)
        self.suffix = vocabulary.get("end_of_word_suffix")
        if self.chunked:
            self.ends = np.zeros(max(vocabulary["vocab"].values()) + 3, bool)
            for token, i in vocabulary["vocab"].items():
                self.ends[i] = token.endswith(self.suffix)

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for i in range(0, len(words), _JOINED) for e in tokenizer(self.path).encode_batch_fast(words[i : i + _JOINED], add_special_tokens=False)]

    def _plain(self, words: list[str]) -> list[bytes]:
        """Of plain words; each has one word end, its last id."""
        out = []
        for i in range(0, len(words), _JOINED):
            part = words[i : i + _JOINED]
            ids = np.asarray(tokenizer(self.path).encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                out += self._each(part)
                continue
            raw, stops = ids.tobytes(), (4 * cuts).tolist()
            out += [raw[a:b] for a, b in zip([0, *stops], stops)]
        return out

    def _learn(self, new: list[str]) -> list[bytes]:
        kinds = _KINDS.findall("\n".join(new))
        if not self.suffix or len(kinds) != len(new):  # a line separator that isn't \n
            return self._each(new)
        known, tails = self.known, self.tails
        stems = {stem: b"" for stem, _, _ in kinds if stem and stem not in known}
        stems.update(zip(stems, self._plain(list(stems))))
        others = {x: b"" for _, _, x in kinds if x}
        others.update(zip(others, self._each(list(others))))
        if more := list({tail for _, tail, _ in kinds} - tails.keys()):
            tails.update((t, ids) for t, ids in zip(more, self._each(more)) if len(t) <= HELD_CHARS)
            others.update(zip(more, self._each(more)))
        return [others[x] if x else (stems[stem] if stem in stems else known[stem]) + (tails[tail] if tail in tails else others[tail]) for stem, tail, x in kinds]

    def encode(self, texts: pa.Array, held: int = HELD_CHUNKS) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, their number in each text); a null is empty. held: chunks that may stay known."""
        if not self.chunked:
            found = [np.asarray(tokenizer(self.path).encode(t or "", add_special_tokens=False).ids, "<u4") for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, "<u4"), *found]), np.array([len(x) for x in found], np.int64)
        known = self.known
        if len(known) > held:
            known.clear()
            known[""] = b""
        texts = pc.fill_null(texts, "")
        # Special tokens are looked for before letters are lower-cased.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        chunks, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        values = list(map(known.get, chunks))
        places = [i for i, ids in enumerate(values) if ids is None]
        new = [chunks[i] for i in places]
        for i, w, ids in zip(places, new, self._learn(new) if new else ()):
            values[i] = ids
            if len(w) <= HELD_CHARS:
                known[w] = ids
        flat = np.frombuffer(b"".join(values), "<u4")
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        starts = np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((starts[codes] - ends + each).astype(np.int64), each)
        at += np.arange(total)
        ids = flat[at]
        upto = np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, np.diff(upto)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One for each Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def encoded(texts: pa.Array, path: str, end: bytes = b"", held: int = HELD_CHUNKS) -> list[bytes]:
    """The ids of each text as little-endian bytes, with those of end after them."""
    ids, counts = encoder(path).encode(texts, held)
    raw, stops = ids.astype("<u4", copy=False).tobytes(), (4 * np.cumsum(counts)).tolist()
    return [raw[a:b] + end for a, b in zip([0, *stops], stops)]
