"""Quality rules by line sequence labelling.

A linear-chain conditional random field labels each line of a text as content or boilerplate; Viterbi decoding finds
the best sequence. A text is kept when at least min_share of its word characters stand in content lines. Weights are
learned from documents with a quality label: their lines carry the document's label, and the field's transitions keep
runs of lines together. The sample that it is fitted on is bounded (max_labelled documents of each class, those with
the smallest hashes of doc_id, of which texts over MAX_LABELLED_BYTES are passed over); everything else covers all rows
and whole texts.

Words are parted by space and the controls 9 to 13 alone, so a line of other blanks (no-break space, U+0085) has a word.
Null and empty texts have no words and fail the base rules (fewer than 20 words); without labelled documents of both
classes the field falls back to fixed prior weights; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, in_pieces, table

MAX_LABELLED = 1200
MAX_LABELLED_BYTES = 32_000
MIN_SHARE = 0.5
MIN_WORDS = 20
WINDOW = 8
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_MARK = re.compile(r"[!?]{2,}")
FEATURES = ("bias", "symbols", "symbol_words", "bars", "repeats", "capitals", "shouts", "marks", "short", "one_word", "no_end", "digits", "word_length", "said_before", "empty")
#: Prior weights of content against boilerplate, for want of labels.
PRIOR = np.array([3.0, -4.0, -4.0, -4.0, -6.0, -4.0, -3.0, -3.0, -0.5, -0.5, -0.5, -1.0, 0.0, -0.5, 0.0])
PRIOR_TRANSITIONS = np.array([[0.7, -0.7], [-0.7, 0.7]])


def line_features(line: str, said_before: bool) -> list[float]:
    words = _WORD.findall(line)
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    chars = sum(map(len, words))
    symbols = len(_SYMBOL.findall(line))
    marked = sum(1 for w in words if not w[-1].isalnum() and _SYMBOL.search(w)) if symbols else 0
    lower = line.lower()
    capitals = sum(1 for w in words if len(w) > 2 and w.isupper())
    return [
        1.0, min(1.0, 5 * symbols / chars), marked / n, min(1.0, 2 * line.count("|") / n), 1 - len(set(words)) / n if n > 3 else 0.0, capitals / n,
        1.0 if lower != line and line.upper() == line else 0.0, min(1.0, 3 * len(_MARK.findall(line)) / n), 1.0 if n < 6 else 0.0, 1.0 if n == 1 else 0.0,
        0.0 if words[-1][-1] in ".!?:;\"'”»" else 1.0, min(1.0, 3 * sum(map(str.isdigit, line)) / chars), min(2.0, abs(chars / n - 5.5) / 5), float(said_before), 0.0,
    ]


def features(text: str) -> tuple[list[list[float]], list[int]]:
    """Features and word characters of each line."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        rows.append(line_features(line, line in seen))
        sizes.append(sum(map(len, _WORD.findall(line))))
        seen.add(line)
    return rows, sizes


def fit(texts: list[tuple[str, int]], steps: int = 120, rate: float = 0.15, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of content (2 x features; boilerplate's are held at 0 by their difference) and transitions, by likelihood."""
    sequences = []
    for text, label in texts:
        rows = features(text)[0]
        sequences += [(np.array(rows[i : i + 64]), label) for i in range(0, len(rows), 64)]
    if len({y for _, y in sequences}) < 2:
        return PRIOR.copy(), PRIOR_TRANSITIONS.copy()
    longest = max(len(x) for x, _ in sequences)
    x, mask = np.zeros((len(sequences), longest, len(FEATURES))), np.zeros((len(sequences), longest))
    y = np.array([label for _, label in sequences])
    for i, (rows, _) in enumerate(sequences):
        x[i, : len(rows)], mask[i, : len(rows)] = rows, 1
    share = np.array([(y == 0).mean(), (y == 1).mean()])
    weight = (0.5 / share)[y]
    theta, trans = np.zeros(len(FEATURES)), np.zeros((2, 2))
    state = [np.zeros_like(theta), np.zeros_like(trans), np.zeros_like(theta), np.zeros_like(trans)]
    n = mask.sum()
    for step in range(1, steps + 1):
        node, pair = _marginals(x @ theta, trans, mask)
        g = ((y[:, None] - node[..., 1]) * mask * weight[:, None]).reshape(-1) @ x.reshape(-1, x.shape[-1]) / n - decay * theta
        both = mask[:, 1:] * mask[:, :-1] * weight[:, None]
        seen = np.zeros((2, 2))
        for k in (0, 1):
            seen[k, k] = both[y == k].sum()
        gt = (seen - (pair * both[..., None, None]).sum((0, 1))) / n - decay * trans
        for value, grad, a, b in ((theta, g, 0, 2), (trans, gt, 1, 3)):
            state[a] = 0.9 * state[a] + 0.1 * grad
            state[b] = 0.99 * state[b] + 0.01 * grad**2
            value += rate * (state[a] / (1 - 0.9**step)) / (np.sqrt(state[b] / (1 - 0.99**step)) + 1e-8)
    return theta, trans


def _marginals(emit: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and pair probabilities of padded sequences by forward and backward sums."""
    n, m = emit.shape
    scores = np.stack([np.zeros_like(emit), emit], -1)
    forward, backward = np.zeros((n, m, 2)), np.zeros((n, m, 2))
    forward[:, 0] = scores[:, 0]
    for t in range(1, m):
        step = np.logaddexp.reduce(forward[:, t - 1, :, None] + trans, 1) + scores[:, t]
        forward[:, t] = np.where(mask[:, t, None] > 0, step, forward[:, t - 1])
    total = np.logaddexp.reduce(forward[:, -1], -1)
    for t in range(m - 2, -1, -1):
        step = np.logaddexp.reduce(trans + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(mask[:, t + 1, None] > 0, step, backward[:, t + 1])
    node = np.exp(forward + backward - total[:, None, None])
    pair = np.exp(forward[:, :-1, :, None] + trans + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
    return node, pair


def viterbi(emit: list[float], trans: list[list[float]]) -> list[int]:
    """The best labels; emit scores content, boilerplate scores 0."""
    (t00, t01), (t10, t11) = trans
    back, a, b = [], 0.0, emit[0]
    for e in emit[1:]:
        from0, from1 = (0 if a + t00 >= b + t10 else 1), (0 if a + t01 > b + t11 else 1)
        back.append((from0, from1))
        a, b = max(a + t00, b + t10), max(a + t01, b + t11) + e
    at = 1 if b >= a else 0
    labels = [at]
    for step in reversed(back):
        at = step[at]
        labels.append(at)
    return labels[::-1]


def repeated_words(words: list[str], size: int = WINDOW) -> int:
    """Words that stand in windows of the size which occur twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == n:
        return 0
    counts, covered, reach = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + size - max(i, reach)
            reach = i + size
    return covered


class Field:
    """Decides on texts with fitted weights."""

    def __init__(self, theta: np.ndarray, trans: np.ndarray, min_share: float = MIN_SHARE):
        self.theta, self.trans, self.min_share = np.asarray(theta), np.asarray(trans).tolist(), min_share

    def content_share(self, text: str) -> float:
        rows, sizes = features(text)
        labels = viterbi((np.array(rows) @ self.theta).tolist(), self.trans)
        total = sum(sizes)
        return sum(s for s, y in zip(sizes, labels, strict=True) if y) / total if total else 0.0

    def judge(self, text: str) -> tuple[int, int, int, int, int, bool, float, bool]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept."""
        words = _WORD.findall(text)
        seen: set[str] = set()
        repeats = 0
        for line in text.split("\n"):
            if line in seen:
                repeats += 1
            elif _WORD.search(line):
                seen.add(line)
        again = repeated_words(words)
        failed = len(words) < MIN_WORDS or 100 * again > 30 * len(words)
        share = self.content_share(text)
        return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), repeats, again, failed, share, not failed and share >= self.min_share


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[tuple[str, int]]:
    """At most max_labelled texts of each quality, the same ones at every run."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1) and doc_id is not null").dropDuplicates(["doc_id"])
    halves = [marked.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled) for q in (0, 1)]
    wanted = {r.doc_id: r.quality for half in halves for r in half.collect()}
    if not wanted:
        return []
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(wanted)], "doc_id long")
    found = docs.select("doc_id", "text").filter(F.octet_length("text") <= MAX_LABELLED_BYTES).join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return [(r.text, wanted[r.doc_id]) for r in found.orderBy("doc_id").collect()]


def fitted(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    return fit(labelled_sample(docs, labels, max_labelled))


def judge_documents(docs: DataFrame, theta: np.ndarray, trans: np.ndarray, min_share: float = MIN_SHARE) -> DataFrame:

    def run(batches):
        field = Field(theta, trans, min_share)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.bool_())
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
        for batch in in_pieces(batches):
            rows = [field.judge(t or "") for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
            if rows:
                yield pa.record_batch(columns, names=names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """docs without the rows that the rules reject."""
    theta, trans = fitted(docs, labels)

    def kept(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        field = Field(theta, trans, min_share)
        for texts in parts:
            yield pd.Series([field.judge(t or "")[-1] for t in texts], dtype=bool)

    kept.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.filter(F.pandas_udf(kept, "boolean")("text"))


def op6_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge_documents(docs, *fitted(docs, table(spark, sf_dir, "labels")))
