"""Quality by a linear-chain conditional random field over a document's lines.

Every line gets features of its bytes (shares of capitals, digits, marks and
so on, words that repeat their neighbour) and the same features of the lines
before and after it. The field labels lines good or bad; the length-weighted
mean of the lines' marginal probabilities of being good, by forward-backward,
is the document's quality.

Trained on a bounded sample of labelled documents (SAMPLE, the smallest hashes
of the ids), whose lines take the document's label.

Defined results: null, empty and blank texts have quality 0; lines end at
line feeds, whatever the length; rows that repeat get equal qualities; of ids
that repeat in training the smallest text counts; a quality at the threshold is
kept; no rows in give no rows; without labels of both kinds all texts get the
quality of the kind that there is (one half without any); ids may be null or of
any type; other columns may have any names and types.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvex.plans.util import cut, fresh, join_checked, quoted, spread, table

#: Labelled documents that the field is fitted on, at most.
SAMPLE = 3000
#: Below this quality a document is rejected; under one half, as losing a clean document costs more than keeping a bad one.
THRESHOLD = 0.3
#: Bytes of text whose features are computed at once.
CHUNK = 1 << 20

_CLASS = np.full(256, 7, np.uint8)  # 7: other marks
_CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = 0
_CLASS[128:] = 0
_CLASS[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 1
_CLASS[np.frombuffer(b"0123456789", np.uint8)] = 2
_CLASS[np.arange(33)] = 3
_CLASS[np.frombuffer(b".,;:'\"()-?", np.uint8)] = 4
_CLASS[ord("!")] = 5
_CLASS[ord("|")] = 6
_PRIME = 0x9E3779B97F4A7C15 | 1
OWN = 12


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.full(n, _PRIME, np.uint64)
    step[0] = 1
    back = np.full(n, pow(_PRIME, -1, 1 << 64), np.uint64)
    back[0] = 1
    return np.multiply.accumulate(step), np.multiply.accumulate(back)


def line_features(data: np.ndarray, offsets: np.ndarray, powers: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents data[offsets[i]:offsets[i + 1]] (UTF-8): features of each line, its length in bytes, and its document.

    Every document has a line at least; a line holds its line feed.
    """
    docs, n = len(offsets) - 1, int(offsets[-1] - offsets[0])
    data = data[offsets[0] : offsets[-1]]
    begins = offsets[:-1] - offsets[0]
    after = np.flatnonzero(data == 10) + 1
    after = after[after < n]
    after = after[~np.isin(after, begins)]  # a document's last line feed begins no line
    starts = np.concatenate((begins, after))
    owner = np.concatenate((np.arange(docs), np.searchsorted(begins, after, side="right") - 1))
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.append(starts[1:], n)
    size = ends - starts
    lines = len(starts)
    line = np.repeat(np.arange(lines), size)
    kind = _CLASS[data]
    counts = np.bincount(line * 8 + kind, minlength=lines * 8).reshape(lines, 8).astype(np.float64)
    # Words, and those equal to the word before in the line
    blank = kind == 3
    opens = ~blank
    opens[1:] &= blank[:-1] | (line[1:] != line[:-1])
    closes = ~blank
    closes[:-1] &= blank[1:] | (line[1:] != line[:-1])
    w0, w1 = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    words = np.bincount(line[w0], minlength=lines).astype(np.float64)
    again = np.zeros(lines)
    if len(w0) > 1:
        power, back = powers if powers is not None and len(powers[0]) >= n else _powers(n)
        total = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)))
        value = (total[w1] - total[w0]) * back[w0]
        same = (value[1:] == value[:-1]) & (line[w0[1:]] == line[w0[:-1]]) & (np.diff(w0) > 0)
        again = np.bincount(line[w0[1:][same]], minlength=lines).astype(np.float64)
    ink = np.maximum(size - counts[:, 3], 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    x = np.empty((lines, OWN))
    x[:, 0] = 1
    x[:, 1] = counts[:, 1] / letters
    x[:, 2] = counts[:, 2] / ink
    x[:, 3] = counts[:, 4] / ink
    x[:, 4] = np.minimum(counts[:, 5] / ink, 0.2) * 5
    x[:, 5] = np.minimum(counts[:, 6] / np.maximum(words, 1), 0.5) * 2
    x[:, 6] = np.minimum(counts[:, 7] / ink, 0.2) * 5
    x[:, 7] = again / np.maximum(words - 1, 1)
    x[:, 8] = np.minimum(ink / np.maximum(words, 1), 20) / 10
    x[:, 9] = np.log1p(size) / 5
    x[:, 10] = words == 0
    x[:, 11] = words < 4
    return x, size, owner


def with_neighbours(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Own features, then those of the lines before and after (zeros at a document's ends)."""
    out = np.zeros((len(x), 3 * OWN))
    out[:, :OWN] = x
    if len(x) > 1:
        same = (owner[1:] == owner[:-1])[:, None]
        out[1:, OWN : 2 * OWN] = x[:-1] * same
        out[:-1, 2 * OWN :] = x[1:] * same
    return out


def forward_backward(score: np.ndarray, owner: np.ndarray, start: float, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals P(good) of lines, expected [2, 2] transition counts (each by the weight of its second line), log partition; score: log odds of good; trans: log weights from bad/good to bad/good."""
    lines = len(score)
    if not lines:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    length = np.diff(np.append(first, lines))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    e = np.ones((lines, 2))
    e[:, 1] = np.exp(np.clip(score, -40, 40))
    t = np.exp(trans)
    alpha, norm = np.empty((lines, 2)), np.empty(lines)
    longest = int(length[0])
    active = np.searchsorted(-length, -np.arange(longest), side="left")  # documents with more than k lines
    a = e[first] * np.array([1.0, np.exp(start)])
    for k in range(longest):
        at = first[: active[k]] + k
        if k:
            a = (a[: active[k]] @ t) * e[at]
        z = a.sum(axis=1)
        a = a / z[:, None]
        alpha[at], norm[at] = a, z
    beta = np.empty((lines, 2))
    b = np.ones((0, 2))
    expected = np.zeros((2, 2))
    for k in range(longest - 1, -1, -1):
        at = first[: active[k]] + k
        if k + 1 < longest:
            nxt = first[: active[k + 1]] + k + 1
            g = e[nxt] * b / norm[nxt][:, None]
            expected += (alpha[nxt - 1].T @ (g if weight is None else g * weight[nxt][:, None])) * t
            b = np.concatenate((g @ t.T, np.ones((active[k] - active[k + 1], 2))))
        else:
            b = np.ones((active[k], 2))
        beta[at] = b
    return alpha[:, 1] * beta[:, 1], expected, float(np.log(norm).sum())


class LineField:
    """Weights of a fitted field."""

    def __init__(self, weights: np.ndarray, start: float, trans: np.ndarray):
        self.weights, self.start, self.trans = weights, start, trans

    @classmethod
    def fit(cls, texts: list[str], good: list[bool], steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> LineField:
        """Maximum weighted likelihood of whole documents by Adam: a document's weight is one over the number of lines of its class, in all features alike."""
        field = cls(np.zeros(3 * OWN), 0.0, np.zeros((2, 2)))
        if not texts or len(set(good)) < 2:
            field.weights[0] = 0.0 if not texts else (4.0 if good[0] else -4.0)
            return field
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"".join(raw) or b" ", np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        parts = [(i, line_features(data, offsets[i : j + 1])) for i, j in chunks(offsets, CHUNK)]
        x = np.concatenate([with_neighbours(f, own) for _, (f, _, own) in parts])
        owner = np.concatenate([own + i for i, (_, _, own) in parts])
        y = np.asarray(good, float)[owner]
        # A document's lines have one label, so that this is a weight of the document; both classes weigh the same.
        weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        first = np.append(True, owner[1:] != owner[:-1])
        pairs = np.zeros((2, 2))
        inner = ~first[1:]
        np.add.at(pairs, (y[:-1][inner].astype(int), y[1:][inner].astype(int)), weight[1:][inner])
        param = np.zeros(len(field.weights) + 5)
        m, v = np.zeros_like(param), np.zeros_like(param)
        for step in range(1, steps + 1):
            w, start, trans = param[:-5], param[-5], param[-4:].reshape(2, 2)
            p, expected, _ = forward_backward(x @ w, owner, start, trans, weight)
            gradient = np.concatenate([((y - p) * weight) @ x, [((y - p) * weight)[first].sum()], (pairs - expected).ravel()]) - decay * param
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            param = param + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        field.weights, field.start, field.trans = param[:-5], float(param[-5]), param[-4:].reshape(2, 2)
        return field

    def quality(self, data: np.ndarray, offsets: np.ndarray, powers=None) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, by document."""
        docs = len(offsets) - 1
        if not docs:
            return np.zeros(0)
        if offsets[-1] == offsets[0]:
            return np.zeros(docs)
        x, size, owner = line_features(data, offsets, powers)
        p, _, _ = forward_backward(with_neighbours(x, owner) @ self.weights, owner, self.start, self.trans)
        weight = size * (x[:, 10] == 0)  # blank lines count for nothing
        total = np.bincount(owner, weight, docs)
        return np.where(total > 0, np.bincount(owner, weight * p, docs) / np.maximum(total, 1), 0.0)


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; nulls are empty."""
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None and array.buffers()[2].size else np.zeros(1, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about size bytes, one document at least."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, end
        at = end


def scorer(field: LineField):
    """A column function: text to quality."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        powers = _powers(CHUNK + 1)
        for texts in batches:
            data, offsets = text_buffers(texts)
            parts = [field.quality(data, offsets[i : j + 1], powers) for i, j in chunks(offsets, CHUNK)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> LineField:
    """Fits the field on at most sample labelled documents."""
    # Of an id that repeats, the smallest text counts, and the label is good if any says so.
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("kx_id")).agg((F.max("quality") > 0).alias("kx_good"))
    chosen = chosen.orderBy(F.xxhash64("kx_id", F.lit(9)), "kx_id").limit(sample)
    ids = docs.select(quoted(id_col).alias("kx_id"), quoted(text_col).cast("string").alias("kx_text"))
    rows = join_checked(ids, cut(chosen), ["kx_id"], "inner", 24).groupBy("kx_id", "kx_good").agg(F.min("kx_text").alias("kx_text")).orderBy("kx_id").collect()
    return LineField.fit([r.kx_text for r in rows], [r.kx_good for r in rows])


def qualities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, quality, keep) of every row of docs."""
    score = scorer(train(docs, labels, id_col=id_col, text_col=text_col))
    rows = spread(docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text")))
    out = rows.select("doc_id", F.round(score(F.col("text")), 6).alias("quality"))
    return out.withColumn("keep", F.col("quality") >= THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that qualities() would keep, with all their columns."""
    name = fresh(docs, "kx_quality")
    score = scorer(train(docs, labels, id_col=id_col, text_col=text_col))
    return docs.withColumn(name, F.round(score(quoted(text_col).cast("string")), 6)).where(F.col(name) >= THRESHOLD).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
