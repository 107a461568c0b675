"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

Patterns give the base spans. The network, in numpy, scores every candidate with the
text around it: base findings, which get a score and stay whatever it says, and all
other long strings of key characters, which become spans where the score reaches the
threshold. A candidate of any length is read whole, in overlapping windows, and has the
score of its best window. What a base span leaves of a longer string is a candidate of
its own, and so is each part of it between slashes, dots and equal signs; where a part is
found, it is the span, and not the string around it.

The network is trained on labelled findings (before, value, after, is it a secret), a
bounded list, by default ``EXAMPLES`` generated ones. Groups of other findings calibrate
it, by default new ones of the same kinds and ones of kinds that no training finding has;
its threshold is the highest that still finds the wanted share of each group's secrets.

Cases: a null or empty text has no spans. Positions are code points, ends exclusive.
Texts of any length are scanned whole; windows are scored in bounded batches. Repeated
rows give a row each; spans that start alike are in the order of their kinds. Other
columns travel under a prefix, so their names may clash with any of ours. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, strings

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_PART = re.compile(r"[A-Za-z0-9+_-]{16,}")
KINDS = ("assign", "access", "hex", "model")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Generated labelled findings for training, half of them secrets, those for calibration, and the share of its secrets to find.
EXAMPLES, CALIBRATION, RECALL = 4000, 1000, 0.95
#: The shortest candidate, and letters alone that are one.
LEAST, LETTERS = 16, 20
BEFORE, VALUE, AFTER = 24, 40, 8
_WIDTH, _FILTERS, _EMBED = 5, 24, 8


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, by start, then kind as listed."""
    out = []
    raw = text.encode()
    low = raw.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # A run is maximal where it starts a match, so the shortest length can stand in the pattern.
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _likely(value: str) -> bool:
    """Whether a string can be a key: letters with digits or with capitals inside, or many letters alone."""
    letters = sum(map(str.isalpha, value))
    return len(value) >= LEAST and letters > 0 and (any(map(str.isdigit, value)) or any(map(str.isupper, value[1:])) and any(map(str.islower, value)) or letters >= LETTERS)


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, parts): long strings of key characters outside the base spans, and their parts between slashes, dots and equal signs."""
    out = []
    at = 0
    for m in CANDIDATE.finditer(text):
        a, stop = m.span()
        open_ = []
        while at < len(base) and base[at][1] <= a:
            at += 1
        i = at
        while i < len(base) and base[i][0] < stop:
            if base[i][0] > a:
                open_.append((a, base[i][0]))
            a = max(a, base[i][1])
            i += 1
        for a, b in [*open_, (a, stop)]:
            value = text[a:b].rstrip(".=-_/+")
            if _likely(value):
                parts = [(a + p.start(), a + p.end()) for p in _PART.finditer(value) if p.end() - p.start() < len(value) and _likely(p[0])]
                out.append((a, a + len(value), parts))
    return out


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """Places of a candidate's windows, each sharing half with the next, the last one full."""
    if b - a <= VALUE:
        return [(a, b)]
    return [(x, x + VALUE) for x in (*range(a, b - VALUE, VALUE // 2), b - VALUE)]


def _coded(before: str, value: str, after: str) -> list[int]:
    """Codes of a window of VALUE characters at most and of what stands before and after it."""
    row = before[-BEFORE:].rjust(BEFORE, "\0") + value.ljust(VALUE, "\0") + after[:AFTER].ljust(AFTER, "\0")
    return [ord(c) if ord(c) < 127 else 127 for c in row]


def _shape(value: str) -> list[float]:
    counts = Counter(value)
    n = len(value) or 1
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    kinds = [3 if not c.isalnum() else 0 if c.isdigit() else 1 if c.isupper() else 2 for c in value]
    return [min(n, 100) / 40, entropy / 5, sum(c.isdigit() for c in value) / n, sum(c.isupper() for c in value) / n, sum(a != b for a, b in zip(kinds, kinds[1:])) / n]


class Network:
    """Embedding, one convolution, pooling over the text before and over the value, one dense layer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        dense = 3 * _FILTERS + 5
        self.w = {
            "embed": rng.normal(0, 0.3, (128, _EMBED)),
            "conv": rng.normal(0, 0.15, (_WIDTH * _EMBED, _FILTERS)),
            "bias": np.zeros(_FILTERS),
            "dense": rng.normal(0, 0.1, dense),
            "out": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, codes: np.ndarray, shape: np.ndarray):
        n, length = codes.shape
        x = self.w["embed"][codes]
        wide = np.lib.stride_tricks.sliding_window_view(x, _WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, length - _WIDTH + 1, _WIDTH * _EMBED)
        h = np.maximum(wide @ self.w["conv"] + self.w["bias"], 0)
        a, v = h[:, : BEFORE - 2], h[:, BEFORE - 2 : BEFORE + VALUE - 2]
        pooled = np.concatenate([a.max(1), v.max(1), v.mean(1), shape], 1)
        return wide, h, pooled, pooled @ self.w["dense"] + self.w["out"][0]

    def logits(self, codes: np.ndarray, shape: np.ndarray) -> np.ndarray:
        return self._forward(codes, shape)[3]

    def probability(self, codes: np.ndarray, shape: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(codes, shape) + self.shift, -50, 50)))

    def _gradients(self, codes: np.ndarray, shape: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        wide, h, pooled, z = self._forward(codes, shape)
        n, length = codes.shape
        d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        dp = d[:, None] * self.w["dense"]
        dh = np.zeros_like(h)
        row, col = np.arange(n)[:, None], np.arange(_FILTERS)[None]
        dh[row, h[:, : BEFORE - 2].argmax(1), col] += dp[:, :_FILTERS]
        dh[row, h[:, BEFORE - 2 : BEFORE + VALUE - 2].argmax(1) + BEFORE - 2, col] += dp[:, _FILTERS : 2 * _FILTERS]
        dh[:, BEFORE - 2 : BEFORE + VALUE - 2] += dp[:, None, 2 * _FILTERS : 3 * _FILTERS] / VALUE
        dh *= h > 0
        dwide = (dh @ self.w["conv"].T).reshape(n, length - _WIDTH + 1, _WIDTH, _EMBED)
        dx = np.zeros((n, length, _EMBED))
        for k in range(_WIDTH):
            dx[:, k : k + length - _WIDTH + 1] += dwide[:, :, k]
        embed = np.zeros_like(self.w["embed"])
        np.add.at(embed, codes, dx)
        return {"embed": embed, "conv": np.einsum("nlw,nlf->wf", wide, dh), "bias": dh.sum((0, 1)), "dense": pooled.T @ d, "out": np.array([d.sum()])}

    def fit(self, codes: np.ndarray, shape: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, batch: int = 64, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                at = order[i : i + batch]
                step += 1
                for k, g in self._gradients(codes[at], shape[at], y[at]).items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], recall: float) -> None:
        """Platt's scale and shift, by damped Newton steps; then the highest threshold that finds recall of each group's secrets."""
        codes, shape, y = (np.concatenate(x) for x in zip(*groups))
        z = self.logits(codes, shape)
        unit = float(z.std()) or 1.0
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        x = np.stack([z / unit, np.ones_like(z)], 1)
        w = np.array([1.0, 0.0])
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), x.T @ (p - t) + 0.01 * w)
            w -= step * min(1.0, 0.5 / np.abs(step).max())
        self.scale, self.shift = float(w[0]) / unit, float(w[1])
        found = [np.sort(self.probability(c, s)[labels > 0]) for c, s, labels in groups]
        self.threshold = min(float(p[min(len(p) - 1, int((1 - recall) * len(p)))]) for p in found if len(p))


def _string(rng: random.Random, letters: str, n: int) -> str:
    return "".join(rng.choices(letters, k=n))


def findings(n: int = EXAMPLES, seed: int = 11, fresh: bool = False) -> list[tuple[str, str, str, int]]:
    """Labelled findings (before, value, after, secret 0 or 1), generated in equal parts; fresh: of kinds that the others don't have."""
    rng = random.Random(seed)
    alnum, url, hexa = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "_-", "0123456789abcdef"
    b64 = string.ascii_letters + string.digits + "+/"
    syllables = ("al bri com da es fu gra hin is jo kla le mi nau or pol rin so tur us vi wen xa ye zu" if fresh else "an be con der ein for ge hat in ja ker lo men nor on per qua re st th un ver wo za").split()
    word = lambda: _string(rng, syllables, rng.randint(1, 4))
    secret = [
        lambda: "ghp_" + _string(rng, alnum, 36),
        lambda: "gho_" + _string(rng, alnum, 36),
        lambda: "glpat-" + _string(rng, url, 20),
        lambda: f"xoxb-{_string(rng, string.digits, 11)}-{_string(rng, string.digits, 12)}-{_string(rng, alnum, 24)}",
        lambda: rng.choice(["sk_live_", "rk_live_", "pk_live_"]) + _string(rng, alnum, 24),
        lambda: "sk-" + _string(rng, alnum, 48),
        lambda: "AIza" + _string(rng, url, 35),
        lambda: f"eyJ{_string(rng, url, 33)}.eyJ{_string(rng, url, 60)}.{_string(rng, url, 43)}",
        lambda: f"SG.{_string(rng, url, 22)}.{_string(rng, url, 43)}",
        lambda: rng.choice(["npm_", "hf_", "dop_v1_", "shpat_"]) + _string(rng, alnum, 36),
        lambda: _string(rng, b64, rng.choice([32, 40, 44, 64])) + rng.choice(["", "=", "=="]),
        lambda: _string(rng, alnum, rng.randint(20, 48)),
        lambda: _string(rng, string.ascii_uppercase + "234567", rng.choice([26, 32, 52])),
        lambda: _string(rng, "0123456789ABCDEF", rng.choice([32, 40, 64])),
        lambda: _string(rng, hexa, rng.choice([32, 40, 64])),
        lambda: "AKIA" + _string(rng, string.ascii_uppercase + string.digits, 16),
    ]
    plain = [
        lambda: "".join(word().capitalize() for _ in range(rng.randint(3, 6))) + str(rng.randint(0, 99)),
        lambda: "_".join(word() for _ in range(rng.randint(3, 7))) + f"_{rng.randint(0, 9999)}",
        lambda: "-".join(word() for _ in range(rng.randint(3, 8))) + f"-{rng.randint(1, 2030)}",
        lambda: "/" + "/".join(word() for _ in range(rng.randint(3, 6))) + f"/{word()}{rng.randint(0, 99)}.{rng.choice(['html', 'txt', 'py', 'jpg'])}",
        lambda: f"www.{word()}{word()}.{word()}.{rng.choice(['com', 'org', 'net'])}/{word()}/{rng.randint(0, 9999)}",
        lambda: f"{word()}.{word()}{rng.randint(0, 99)}.{word()}.{word()}.example.{rng.choice(['com', 'org', 'net'])}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}.{rng.randint(10, 59)}.{rng.randint(10, 59)}.000Z",
        lambda: f"v{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}-{word()}.{rng.randint(0, 9)}-{word()}{word()}",
        lambda: f"{word()}_{_string(rng, string.digits, rng.randint(14, 24))}",
        lambda: f"{_string(rng, hexa, 8)}-{_string(rng, hexa, 4)}-4{_string(rng, hexa, 3)}-a{_string(rng, hexa, 3)}-{_string(rng, hexa, 12)}",
        lambda: "".join(word() for _ in range(rng.randint(6, 12))) + str(rng.randint(0, 9)),
        lambda: word().upper() + "_" + word().upper() + "_" + word().upper() + word().upper() + f"_{rng.randint(0, 99)}",
        lambda: ".".join(word() for _ in range(rng.randint(4, 7))) + f".{rng.randint(0, 9)}",
        lambda: f"{word()}{'=' * rng.randint(12, 30)}{rng.randint(0, 9)}",
    ]
    if fresh:
        upper, digits = string.ascii_uppercase, string.digits
        secret = [
            lambda: _string(rng, b64, 40),
            lambda: "ya29." + _string(rng, url, rng.randint(40, 90)),
            lambda: "pypi-AgE" + _string(rng, url, rng.randint(60, 150)),
            lambda: "whsec_" + _string(rng, b64, 32),
            lambda: f"xapp-1-A{_string(rng, upper + digits, 10)}-{_string(rng, digits, 13)}-{_string(rng, alnum, 40)}",
            lambda: "EAA" + _string(rng, alnum, rng.randint(60, 120)),
            lambda: "-".join(_string(rng, upper + digits, 5) for _ in range(5)),
            lambda: "sq0csp-" + _string(rng, url, 43),
            lambda: _string(rng, url, rng.randint(18, 32)),
            lambda: f"{_string(rng, digits, 10)}_{_string(rng, url, 35)}",
        ]
        plain = [
            lambda: f"IMG_{rng.randint(2000, 2030)}{rng.randint(10, 12)}{rng.randint(10, 28)}_{rng.randint(100000, 235959)}.{rng.choice(['jpg', 'png', 'mp4'])}",
            lambda: f"978-{rng.randint(0, 9)}-{rng.randint(10, 99)}-{rng.randint(100000, 999999)}-{rng.randint(0, 9)}.{word()}",
            lambda: ".".join([rng.choice(["com", "org", "net"]), word(), word(), "".join(word().capitalize() for _ in range(3))]),
            lambda: f"{word()}.{word()}{rng.randint(1, 99)}.{rng.choice(['mail', 'post', word()])}.example.{rng.choice(['com', 'de', 'fr'])}",
            lambda: f"/{word()}/{word()}-{word()}/{rng.randint(1990, 2030)}/{rng.randint(1, 12)}/{word()}-{word()}-{word()}",
            lambda: "".join(word() for _ in range(rng.randint(5, 9))).capitalize(),
            lambda: "".join(word() for _ in range(rng.randint(5, 9))),
            lambda: f"{word()}{word().capitalize()}{word().capitalize()}{word().capitalize()}{word().capitalize()}",
            lambda: f"SKU-{rng.randint(10000, 99999)}-{word().upper()}-{word().upper()}",
            lambda: f"{word()}/{word()}/{word()}_{word()}.{rng.choice(['py', 'rs', 'go', 'java'])}",
            lambda: f"{word()}--{word()}--{word()}-{word()}-{rng.randint(1, 9)}",
            lambda: f"{word().upper()}_{word().upper()}_{word().upper()}_{word().upper()}",
        ]
    told = ["key: ", "Authorization: Bearer ", "export AUTH=", "credentials ", "aws_secret_access_key ", "bearer ", "auth: ", "client_secret is ", "access key ", "private key = "]
    out = []
    for i in range(n):
        y = i % 2
        before = " ".join(word() for _ in range(4)) + " "
        if rng.random() < (0.5 if y else 0.05):
            before += rng.choice(told)
        out.append((before, rng.choice(secret if y else plain)(), rng.choice(['"', " ", "\n", ". ", ", "]) + word(), y))
    return out


def _arrays(labelled: list[tuple[str, str, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, shapes and labels of all windows of labelled findings."""
    codes, shape, y = [], [], []
    for before, value, after, secret in labelled:
        for a, b in windows(0, len(value)):
            codes.append(_coded((before + value[:a])[-BEFORE:], value[a:b], value[b:] + after))
            shape.append(_shape(value[a:b]))
            y.append(secret)
    return np.array(codes), np.array(shape), np.array(y, float)


def trained(labelled: list[tuple[str, str, str, int]] | None = None, calibration: list[list[tuple[str, str, str, int]]] | None = None, recall: float = RECALL) -> Network:
    """A network fitted on labelled findings and calibrated on groups of others, each of which must be found. All lists are bounded by their maker."""
    groups = [findings(CALIBRATION, 12), findings(CALIBRATION, 13, fresh=True)] if calibration is None else calibration
    net = Network()
    net.fit(*_arrays(findings() if labelled is None else labelled))
    net.calibrate([_arrays(g) for g in groups], recall)
    return net


def score(texts: list[str], wanted: list[tuple[int, int, int]], net: Network, batch: int = 512) -> np.ndarray:
    """The probability of each (text, start, end): that of its best window."""
    out = np.zeros(len(wanted))
    rows: list[tuple[int, int, int, int]] = []

    def flush() -> None:
        codes = np.array([_coded(texts[i][max(0, a - BEFORE) : a], texts[i][a:b], texts[i][b : b + AFTER]) for _, i, a, b in rows])
        p = net.probability(codes, np.array([_shape(texts[i][a:b]) for _, i, a, b in rows]))
        np.maximum.at(out, [k for k, _, _, _ in rows], p)
        rows.clear()

    for k, (i, a, b) in enumerate(wanted):
        for x, y in windows(a, b):
            rows.append((k, i, x, y))
            if len(rows) == batch:
                flush()
    if rows:
        flush()
    return out


def scored_spans(texts: list[str], net: Network) -> list[list[tuple[int, int, str, float]]]:
    """All spans of each text with their scores, by start, then kind as listed. A base finding is scored by its value."""
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    wanted, whole = [], []
    for i, t in enumerate(texts):
        base = base_spans(t)
        for a, b, kind in base:
            # A key word, a sign and quotes stand before an assigned value.
            wanted.append((i, b - len(ASSIGN.match(t, a)[2]) if kind == "assign" else a, b))
            out[i].append((a, b, kind, 0.0))
        whole.append(len(wanted))
        for a, b, parts in candidates(t, base):
            wanted += [(i, a, b), *[(i, x, y) for x, y in parts]]
    p = score(texts, wanted, net).tolist()
    at = 0
    for i, (spans, first) in enumerate(zip(out, whole)):
        spans[:] = [(a, b, kind, p[at + k]) for k, (a, b, kind, _) in enumerate(spans)]
        at = first
        while at < len(wanted) and wanted[at][0] == i:
            (_, a, b), q, stop = wanted[at], p[at], at + 1
            while stop < len(wanted) and wanted[stop][0] == i and wanted[stop][2] <= b:
                stop += 1
            # Where parts of a string are found, they are the spans; the string itself only where none is.
            parts = [(x, y, "model", r) for (_, x, y), r in zip(wanted[at + 1 : stop], p[at + 1 : stop]) if r >= net.threshold]
            spans += parts or [(a, b, "model", q)] * (q >= net.threshold)
            at = stop
        spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def find(texts: list[str], net: Network) -> list[list[tuple[int, int, str]]]:
    """All spans of each text, by start, then kind as listed."""
    return [[x[:3] for x in spans] for spans in scored_spans(texts, net)]


_SPAN = ("starts", "ends", "kinds", "scores")


def scan(docs: DataFrame, net: Network | None = None, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", redact: str | None = None) -> DataFrame:
    """id_cols under their names with in_ before, __t if redact is given (the text with that in place of its spans), and starts, ends, kinds, scores."""
    shared = docs.sparkSession.sparkContext.broadcast(net or trained())  # a network of fixed size
    rows = docs.select(*[F.col(c).alias(f"in_{c}") for c in id_cols], F.col(text_col).cast("string").alias("__t"))
    kept = rows.columns if redact is not None else rows.columns[:-1]
    lists = [F.expr(f"cast(array() as array<{t}>)").alias(n) for n, t in zip(_SPAN, ("long", "long", "string", "double"))]

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = strings(part.column("__t"))
        spans = scored_spans(texts, shared.value)
        columns = {c: part.column(c) for c in kept}
        if redact is not None:
            columns["__t"] = pa.array([None if old is None else redacted(t, s, redact) for old, t, s in zip(part.column("__t").to_pylist(), texts, spans)], pa.string())
        return pa.RecordBatch.from_arrays([*columns.values(), *[pa.array([[x[i] for x in s] for s in spans], pa.list_(kind)) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.float64()))]], names=[*kept, *_SPAN])

    return map_text(rows, work, rows.select(*kept, *lists).schema, "__t")


def redacted(text: str, spans: list[tuple], by: str) -> str:
    """The text with by in place of each span; spans that overlap count as one."""
    out, done = [], 0
    for a, b, *_ in spans:
        if a >= done:
            out += [text[done:a], by]
        done = max(done, b)
    return "".join([*out, text[done:]]) if spans else text


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document; n_model (spans of the network), and scores of all spans in order."""
    found = scan(docs)
    joined = lambda only: F.concat_ws(",", F.transform(F.filter(F.arrays_zip("starts", "ends", "kinds"), only), lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string"))))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    return found.select(
        F.col("in_doc_id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(lambda x: x["kinds"] != "model"), 256).alias("base_sha256"), joined(lambda x: F.lit(True)).alias("spans"), count("model").alias("n_model"), F.transform("scores", lambda x: F.round(x, 4)).alias("scores")
    )


def redact_secrets(docs: DataFrame, by: str = "[secret]") -> DataFrame:
    """docs, all columns, with each span of a text replaced; n_chars, if there is one, follows."""
    others = tuple(c for c in docs.columns if c != "text")
    out = scan(docs, id_cols=others, redact=by).select(*[F.col("__t" if c == "text" else f"in_{c}").alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
