"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Each rule looks at one measure of a text and votes good, bad or nothing. The votes of
all documents meet in a table of vote patterns, whose size the number of rules
bounds. Expectation-maximisation over that table estimates how often each rule votes
so on good and on bad documents, and gives each pattern its posterior probability of
good quality. No labels are needed. A rule that fails alone does not reject a
document, unless it has shown to be that telling.

Cases: a null or empty text has no words, every rule abstains, and the base rule
rejects it. Repeated rows are judged alike. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, saved, utf8

WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
_SYMBOLS = b"#*$%&|<>"
_LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_NOT_LETTERS = bytes(set(range(256)) - set(_LETTERS))
_NOT_WORDS = bytes(set(range(256)) - set(_LETTERS) - set(b" \t\n\r\x0b\x0c"))
_NOT_UPPER = bytes(set(range(256)) - set(range(0x41, 0x5B)))
_NOT_DIGITS = bytes(set(range(256)) - set(range(0x30, 0x3A)))
_CONTINUED = bytes(range(0x80, 0xC0))
#: Frequent function words of English, German, French and Spanish.
_COMMON = frozenset(
    w.encode()
    for w in "the of and to in is that it was for on are as with be by this have from or an der die und das den von zu ist mit des im nicht ein eine auf dem sich le la les de et des un une que en du dans est pour qui pas sur au par el los las y del se por con una su para al lo como".split()
)

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_ended_lines long, n_letter_words long, n_distinct long, n_common long, n_letters long, n_upper long, n_digits long"


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, window a power of two.

    Windows are named by rank, doubling their width: two are alike where both halves are.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    width = 1
    while width < window:
        pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        _, rank, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(counts) == len(pair):
            return 0
        width *= 2
    at = np.flatnonzero(counts[rank] > 1)
    edges = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + window, minlength=n + 1)[: n + 1]
    return int(np.count_nonzero(np.cumsum(edges)[:n]))


def measure(text: bytes) -> tuple[int, ...]:
    """The values of MEASURES."""
    words = text.split()
    joined = b"".join(words)
    lines, seen, repeats, ended = 0, set(), 0, 0
    for line in text.split(b"\n"):
        if bare := line.rstrip():
            lines += 1
            repeats += line in seen
            seen.add(line)
            ended += bare.endswith((b".", b"!", b"?", b":", b";", b'"', b"'", b")", "…".encode(), "”".encode(), "»".encode()))
    return (
        len(words),
        len(joined.translate(None, _CONTINUED)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        repeats,
        repeated(words),
        lines,
        ended,
        len(text.translate(None, _NOT_WORDS).split()),
        len(set(words)),
        sum(map(_COMMON.__contains__, words)),
        len(joined.translate(None, _NOT_LETTERS)),
        len(joined.translate(None, _NOT_UPPER)),
        len(joined.translate(None, _NOT_DIGITS)),
    )


def measured(docs: DataFrame, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",), keep_text: bool = False) -> DataFrame:
    """id_cols under their names with in_ before, the text if asked for, and MEASURES."""
    rows = docs.select(*[F.col(c).alias(f"in_{c}") for c in id_cols], F.col(text_col).cast("string").alias("__t"))
    names = [x.split()[0] for x in MEASURES.split(", ")]
    kept = rows.columns if keep_text else rows.columns[:-1]
    schema = rows.select(*kept, *[F.lit(0).cast("long").alias(n) for n in names]).schema

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([measure(t) for t in utf8(part.column("__t"))], np.int64).reshape(part.num_rows, len(names))
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *[pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(names))]], names=[*kept, *names])

    return map_text(rows, work, schema, "__t")


def rules() -> dict[str, tuple[F.Column, F.Column]]:
    """name: (votes bad, votes good); a rule abstains between, and on texts without words."""
    c = F.col
    share = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    return {
        "symbols": (share("n_symbols", "n_words") > 0.3, share("n_symbols", "n_words") <= 0.05),
        "word_length": ((share("word_chars", "n_words") > 7.5) | (share("word_chars", "n_words") < 3), share("word_chars", "n_words").between(3.8, 6.8)),
        "repeated_lines": (share("n_dup_lines", "n_lines") > 0.3, share("n_dup_lines", "n_lines") <= 0.1),
        "repeated_windows": (share("n_repeat_words", "n_words") > 0.3, share("n_repeat_words", "n_words") <= 0.05),
        "letter_words": (share("n_letter_words", "n_words") < 0.75, share("n_letter_words", "n_words") >= 0.9),
        "capitals": (share("n_upper", "n_letters") > 0.3, share("n_upper", "n_letters") <= 0.1),
        "line_ends": ((share("n_ended_lines", "n_lines") < 0.3) & (c("n_lines") >= 3), share("n_ended_lines", "n_lines") >= 0.8),
        "common_words": ((c("n_common") == 0) & (c("n_words") >= 50), share("n_common", "n_words") >= 0.06),
        "variety": ((share("n_distinct", "n_words") < 0.35) & (c("n_words") < 2000), share("n_distinct", "n_words") >= 0.45),
        "digits": (c("n_digits") > 0.3 * (c("n_letters") + c("n_digits")), c("n_digits") <= 0.1 * (c("n_letters") + c("n_digits"))),
    }


def pattern() -> F.Column:
    """One character for each rule: b, g or - for no vote."""
    return F.concat(*[F.when(F.col("n_words") == 0, "-").when(bad, "b").when(good, "g").otherwise("-") for bad, good in rules().values()])


def fit(counts: dict[str, int], rounds: int = 200, tolerance: float = 1e-9) -> tuple[dict[str, float], dict]:
    """(posterior of good by pattern, the model): expectation-maximisation from the votes alone.

    Each rule has an accuracy for good and one for bad documents: how often its votes are
    right there, smoothed by one document. A rule that abstains says nothing. Votes must
    stay likelier to be right than wrong between the classes, so that these can't change
    places.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, {}
    n = np.array([counts[p] for p in patterns], float)
    votes = np.array([["bg-".index(x) for x in p] for p in patterns])
    one = np.eye(3)[votes][:, :, :2]
    bad, good = one.sum(1).T
    post = 1 / (1 + np.exp(-(good - 3.0 * bad + 0.5)))
    for _ in range(rounds):
        prior = np.clip((n @ post + 1) / (n.sum() + 2), 0.02, 0.98)
        like = []
        for weight in (n * post, n * (1 - post)):
            total = np.einsum("p,prv->rv", weight, one) + 0.5
            like.append(total / total.sum(1, keepdims=True))
        like[1][:, 0] = np.maximum(like[0][:, 0], like[1][:, 0])
        like[1][:, 1] = 1 - like[1][:, 0]
        logs = [np.einsum("prv,rv->p", one, np.log(x)) for x in like]
        new = 1 / (1 + np.exp(np.clip(np.log(1 - prior) + logs[1] - np.log(prior) - logs[0], -500, 500)))
        done = np.abs(new - post).max() < tolerance
        post = new
        if done:
            break
    return dict(zip(patterns, post.tolist())), {"prior": float(prior), "rules": {r: {"good": float(like[0][i, 1]), "bad": float(like[1][i, 0])} for i, r in enumerate(rules())}}


def posteriors(measures: DataFrame) -> tuple[DataFrame, dict]:
    """(pattern, p_good) and the model. At most 3 to the number of rules patterns (59,049) reach the driver."""
    counts = {r["pattern"]: r["count"] for r in measures.select(pattern().alias("pattern")).groupBy("pattern").count().collect()}
    found, model = fit(counts)
    return measures.sparkSession.createDataFrame(list(found.items()), "pattern string, p_good double"), model


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def judged(measures: DataFrame, by_pattern: DataFrame, threshold: float = 0.5) -> DataFrame:
    """measures with p_good, base_failed and kept."""
    rated = measures.withColumn("pattern", pattern()).join(F.broadcast(by_pattern), "pattern", "left")
    return rated.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= threshold))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and p_good of every document."""
    measures = saved(measured(docs))
    out = judged(measures, posteriors(measures)[0])
    return out.select(F.col("in_doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs, all columns, without those that the base rule or the posterior rejects.

    The measures are taken twice, once for the votes of all documents and once beside
    the text; no text is stored or shuffled.
    """
    by_pattern, _ = posteriors(measured(docs, id_cols=()))
    others = tuple(c for c in docs.columns if c != "text")
    rated = judged(measured(docs, id_cols=others, keep_text=True), by_pattern, threshold).where("kept")
    return rated.select(*[F.col("__t" if c == "text" else f"in_{c}").alias(c) for c in docs.columns])
