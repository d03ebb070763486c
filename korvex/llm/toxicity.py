"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two spans counts their common subsequences of three letters, each
weighted by LAMBDA to the power of its stretch in both, and is normalised; a
span is a word, a word without the marks inside it, or a run of single letters
("i d i o t"). Inserted characters only lengthen some stretches, so "idxiot"
stays close to "idiot". Landmarks give the Nyström features on which a linear
support vector machine is trained.

Training is that of a multiple-instance machine (MI-SVM) on labelled sentences:
a sentence is a bag of spans and as toxic as its worst span; sentences of clean
documents are clean, the other sentences of toxic documents may be toxic. The
machine and the toxic sentences' witnesses (the span for which a sentence counts
as toxic) are fitted in turn: the machine is trained on witnesses against spans
of clean sentences (those that score highest are added until none is left), then
every sentence of a toxic document takes as its witness the span that scores
highest, if it is beyond the margin; without such a span it is left out. The
first witnesses are spans that a likelihood-ratio test (EVIDENCE) finds in
sentences of toxic documents rather than in clean ones; how many labels there
are changes what the test can see, but no share of them is asked for.

Witnesses that resemble each other form a family. How often clean sentences
have spans of a family calibrates the machine's scores: a document is toxic if
clean text of its length would hardly have as many (CHANCE), of one family or of
all together. A witness that clean sentences hardly have (RATIO) is enough in a
text of any length; a span that also occurs by accident is not.

A sum over landmarks of kernels is linear in a span's subsequences, so the
trained machine is folded, without approximation, into one table of weights by
letter triple; a span is scored by the triples that it has.

At most SAMPLE toxic labelled documents and twice as many clean ones (by hash)
are used for training. Digits and signs that stand for letters are read as those.

Defined results: null and empty texts, and texts without a span of three
letters, are not toxic; very long words are scored in overlapping windows; rows
that repeat are all reported; of ids that repeat in training the smallest text
counts, and a label says toxic if any does; of equal scores the first span in
order is reported; no labelled toxic document means no toxic one; no rows in
give no rows; ids may be null or of any type; other columns may have any names
and types.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvex.llm.ids import dtype
from korvex.plans.util import cut, join_checked, quoted, spread, table

LAMBDA = 0.8
#: Labelled documents of each label that the machine is trained on, at most.
SAMPLE = 1500
LANDMARKS = 160
#: Letters of a window of a longer word, and the step between windows.
WINDOW, STEP = 24, 10
REMEMBERED = 1 << 18
#: Numbers for letters; the weights are a table of its third power.
ALPHABET = 48
#: Distance from the machine's plane beyond which a span is an insult.
MARGIN = 0.2
#: A document is toxic if clean text of its length has as many insults of a family with less than this chance.
CHANCE = 0.0003
#: What a family that clean text never had counts for.
UNSEEN = 0.1
#: A witness is so many times likelier in a sentence of a toxic document than in a clean one.
RATIO = 25
#: Likelihood-ratio statistic of the first witnesses (a chance of 1 in 100,000), and the most rounds of training.
EVIDENCE, ROUNDS = 19.5, 2
_SINGLES = re.compile(r"(?:(?<=\s)|^)[^\W\d_][\W_]+[^\W\d_][\W_]+[^\W\d_](?![^\W\d_])")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W\d_]+")
_RUN = re.compile(r"(?:(?<=\s)|^)(?:[^\W\d_][\W_]+){2,}[^\W\d_](?=[\W_]|$)")
_TRIPLES: dict[int, tuple[np.ndarray, ...]] = {}


def windows(letters: str) -> list[str]:
    """The letters, in overlapping windows if there are many; none if they have no subsequence of three."""
    if len(letters) <= WINDOW:
        return [letters] if len(letters) > 2 else []
    return [letters[k : k + WINDOW] for k in range(0, len(letters) - WINDOW + STEP, STEP)]


def spans_of_word(word: str) -> list[str]:
    """Letters of a lower-case word, in windows if there are many."""
    word = _OUTER.sub("", word)
    if not word.isalpha():
        word = _INNER.sub("", word.translate(_LEET))
    return windows(word)


def runs(text: str) -> list[str]:
    """Runs of three single letters or more, joined."""
    return [_INNER.sub("", m.group()) for m in _RUN.finditer(text)]


def codes(spans: list[str]) -> np.ndarray:
    """Letters of equally long spans as numbers: a to z, and the others folded into the rest of ALPHABET."""
    points = np.frombuffer("".join(spans).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(spans), -1)
    letter = points - np.uint32(97)
    return np.where(letter < 26, letter, 26 + points % np.uint32(ALPHABET - 26)).astype(np.int32)


def triples(n: int) -> tuple[np.ndarray, ...]:
    """Positions i < j < k of all subsequences of n letters, and their weights."""
    if n not in _TRIPLES:
        at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
        _TRIPLES[n] = (at[:, 0], at[:, 1], at[:, 2], (LAMBDA ** (at[:, 2] - at[:, 0] + 1.0)).astype(np.float32))
    return _TRIPLES[n]


def keys_of(s: np.ndarray) -> np.ndarray:
    """[rows, subsequences] numbers of the letter triples of equally long spans."""
    i, j, k, _ = triples(s.shape[1])
    return (s[:, i] * ALPHABET + s[:, j]) * ALPHABET + s[:, k]


def norms(keys: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Roots of the spans' kernels with themselves: subsequences that recur add up before squaring."""
    rows, n = keys.shape
    flat = (np.arange(rows, dtype=np.int64)[:, None] * ALPHABET**3 + keys).ravel()
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    sums = np.add.reduceat(np.tile(w.astype(np.float64), rows)[order], starts)
    return np.sqrt(np.bincount(flat[starts] // ALPHABET**3, sums**2, rows))


def subsequences(span: str) -> tuple[np.ndarray, np.ndarray]:
    """Letter triples of a span, and the sums of their weights scaled to length one."""
    if len(span) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    keys, inverse = np.unique(keys_of(codes([span]))[0], return_inverse=True)
    v = np.bincount(inverse, triples(len(span))[3], len(keys))
    return keys, v / np.sqrt((v**2).sum())


def kernels(spans: list[str], marks: list[str]) -> np.ndarray:
    """[spans, marks] normalised subsequence kernels."""
    parts = [subsequences(m) for m in marks]
    words = np.unique(np.concatenate([p[0] for p in parts])) if parts else np.zeros(0, np.int64)
    m = np.zeros((len(marks), len(words)))
    for r, (k, v) in enumerate(parts):
        m[r, np.searchsorted(words, k)] = v
    out = np.zeros((len(spans), len(marks)))
    for r, s in enumerate(spans):
        k, v = subsequences(s)
        at = np.searchsorted(words, k)
        known = at < len(words)
        known[known] = words[at[known]] == k[known]
        if known.any():
            out[r] = m[:, at[known]] @ v[known]
    return out


def centres(spans: list[str], n: int) -> list[str]:
    """n spans of which every other one is near one: the farthest span is next."""
    k = kernels(spans, spans)
    chosen, nearest = [0], k[0].copy()
    while len(chosen) < min(n, len(spans)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, k[chosen[-1]])
    return [spans[c] for c in dict.fromkeys(chosen)]


class SpanMachine:
    """The folded machine: triple weights and bias, and how often clean text has a span of each family of insults."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias
        self.marks: list[str] = []
        self.sure: set[str] = set()
        self.family = np.zeros(0, np.int64)
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []
        self.words = 1

    def scores(self, spans: list[str], exact: bool = False) -> np.ndarray:
        """Signed distances, of which those above MARGIN are exact and the others may be upper bounds (unless exact)."""
        out = np.full(len(spans), min(self.bias, -1.0))
        by_length = defaultdict(list)
        for r, s in enumerate(spans):
            if len(s) > 2:
                by_length[len(s)].append(r)
        for n, rows in by_length.items():
            w = triples(n)[3]
            step = max(1, 100_000 // len(w))
            least = float(np.sqrt((w.astype(np.float64) ** 2).sum()))  # no norm is below this one
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                keys = keys_of(codes([spans[r] for r in part]))
                total = (self.table[keys] @ w).astype(np.float64)
                value = np.maximum(total, 0) / least + self.bias
                sure = np.flatnonzero(value > MARGIN) if not exact and self.bias < 0 else np.arange(len(part))
                if len(sure):
                    value[sure] = total[sure] / norms(keys[sure], w) + self.bias
                out[part] = value
        return out

    @classmethod
    def fit(cls, positive: list[str], negative: list[str], seed: int = 4) -> SpanMachine:
        """Of spans of toxic and of clean sentences."""
        none = cls(np.zeros(ALPHABET**3, np.float32), -1.0)
        if not positive:
            return none
        rng = np.random.default_rng(seed)
        stretched = []
        letters = "abcdefghijklmnopqrstuvwxyz"
        for s in positive:
            for _ in range(4):  # an inserted or doubled letter
                k = int(rng.integers(1, len(s)))
                stretched.append(s[:k] + (letters[int(rng.integers(26))] if rng.random() < 0.7 else s[k - 1]) + s[k:])
        own = set(positive) | set(stretched)
        negative = sorted(s for s in set(negative) - own)
        hard = [negative[k] for k in rng.permutation(len(negative))[:1000]]
        machine = none
        spread = centres(positive, LANDMARKS // 2)
        for _ in range(5):
            near = []
            if hard:
                closeness = kernels(hard, positive).max(axis=1)
                near = [hard[k] for k in np.argsort(-closeness, kind="stable")[: LANDMARKS // 3]]
            some = [hard[k] for k in rng.permutation(len(hard))[: LANDMARKS // 6]]
            marks = list(dict.fromkeys(spread + near + some))
            values, vectors = np.linalg.eigh(kernels(marks, marks))
            good = values > 1e-4
            root = vectors[:, good] / np.sqrt(values[good])  # Nyström: features of s are k(s, marks) @ root
            x = kernels([*positive, *stretched, *hard], marks) @ root
            up = len(positive) + len(stretched)
            y = np.concatenate([np.ones(up), -np.ones(len(hard))])
            weight = np.where(y > 0, 0.5 / up, 0.5 / max(1, len(hard)))
            w, b = _hinge(x, y, weight)
            table = np.zeros(ALPHABET**3)
            for beta, mark in zip(root @ w, marks):
                k, v = subsequences(mark)
                table[k] += beta * v
            machine = cls(table.astype(np.float32), b)
            scores = machine.scores(negative)
            known = set(hard)
            more = [negative[k] for k in np.argsort(-scores, kind="stable")[:1000] if scores[k] > 0 and negative[k] not in known]
            if not more:
                break
            hard = hard + more
        return machine

    def calibrate(self, positive: list[str], bears: dict[str, float], clean: Counter, words: int) -> None:
        """Groups insults that resemble each other, counts what clean text has of each group, and finds the insults that bear one more than that."""
        self.marks = positive
        if not positive:
            return
        near = kernels(positive, positive) > 0.4
        family = np.arange(len(positive))
        for _ in range(len(positive)):
            lower = np.where(near, family[None], len(positive)).min(axis=1)
            if (lower == family).all():
                break
            family = lower
        self.family = np.unique(family, return_inverse=True)[1]
        spans = list(clean)
        found = [(s, float(v)) for s, v in zip(spans, self.scores(spans)) if v > MARGIN]
        family = self.families([s for s, _ in found])
        for f in range(self.family.max() + 1):
            own = sorted((v, clean[s]) for (s, v), g in zip(found, family) if g == f)
            score, n = np.array([v for v, _ in own]), np.array([c for _, c in own], float)
            self.seen.append((score, np.append(np.cumsum(n[::-1])[::-1], 0.0)))
        self.words = max(1, words)
        for s, v, f in zip(positive, self.scores(positive, True), self.family):
            known, above = self.seen[f]
            if bears[s] > above[np.searchsorted(known, v - 1e-6)] + 1:
                self.sure.add(s)

    def rate(self, family: int, score: float) -> float:
        """How often, in a word of clean text, the family has a span that scores so high."""
        known, above = self.seen[family]
        return (above[np.searchsorted(known, score - 1e-6)] + UNSEEN) / self.words

    def surprise(self, hits: list[tuple[int, float]], words: int) -> float:
        """Minus the logarithm of the chance that clean text of so many words has the spans (family, score) of the most telling family, or all of them."""
        best = 0.0
        for f in {h[0] for h in hits}:
            own = sorted((v for g, v in hits if g == f), reverse=True)
            for k in {j for j in range(len(own)) if j + 1 == len(own) or own[j + 1] < own[j]}:
                best = max(best, -math.log(max(tail(k + 1, words * self.rate(f, own[k])), 1e-300)))
        rates = sorted(self.rate(*h) for h in hits)
        for k in {j for j in range(len(rates)) if j + 1 == len(rates) or rates[j + 1] > rates[j]}:  # no family has spans as rare more often
            best = max(best, -math.log(max(tail(k + 1, words * rates[k] * len(self.seen)), 1e-300)))
        return best

    def families(self, spans: list[str]) -> np.ndarray:
        return self.family[kernels(spans, self.marks).argmax(axis=1)] if spans else np.zeros(0, np.int64)


def tail(k: int, mean: float) -> float:
    """Chance of k events or more where mean are expected (Poisson)."""
    term = math.exp(-mean)
    below = 0.0
    for i in range(k):
        below += term
        term *= mean / (i + 1)
    if below < 1 - 1e-9:
        return 1 - below
    total = 0.0
    for i in range(k, k + 40):
        total += term
        term *= mean / (i + 1)
    return total


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400, c: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear machine, by subgradients with Adam."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = np.zeros(x.shape[1])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ p))
        g = -((weight * 2 * slack * y) @ x) + c * np.append(p[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        p = p - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return p[:-1], float(p[-1])


_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def places(sentence: str) -> Iterator[tuple[list[str], str]]:
    """Of each word (and each run of single letters): its spans, and its surroundings."""
    words = [_OUTER.sub("", w) for w in sentence.split()]
    for k, word in enumerate(words):
        yield spans_of_word(word), " ".join(words[max(0, k - 1) : k] + ["_"] + words[k + 1 : k + 2])
    for s in runs(sentence):
        yield windows(s), sentence


def bags(texts: list[str], toxic: list[bool]) -> tuple[list[list[str]], list[list[str]], Counter, Counter, Counter, int]:
    """The spans of each differing sentence of toxic documents alone and of clean ones; in how many surroundings the former and the latter have each span; how often clean documents have it, and their number of words."""
    kept: dict[str, bool] = {}  # a sentence counts once, and one that a clean document has is clean
    times, words = Counter(), 0
    for text, bad in sorted(zip(texts, toxic), key=lambda x: x[1]):
        words += 0 if bad else len((text or "").split())
        for sentence in _SENTENCE.findall((text or "").lower()):
            kept.setdefault(sentence, bad)
            times[sentence] += not bad
    out: tuple[list, list] = ([], [])
    # Near copies repeat a span in the same surroundings, so only differing ones are evidence.
    around, clean = (defaultdict(set), defaultdict(set)), Counter()
    for sentence, bad in kept.items():
        own = list(places(sentence))
        for spans, place in own:
            for s in spans:
                around[not bad][s].add(place)
                if not bad:
                    clean[s] += times[sentence]
        out[not bad].append(list(dict.fromkeys(s for spans, _ in own for s in spans)))
    t, c = (Counter({s: len(p) for s, p in x.items()}) for x in around)
    return *out, t, c, clean, words


def evidence(t: int, c: int, share: float) -> float:
    """The likelihood-ratio statistic for a span in t surroundings of toxic and c of clean sentences, if a share of the sentences is toxic; 0 if the clean ones have it rather."""
    p = t / (t + c)
    return 2 * (t * math.log(p / share) + (c * math.log((1 - p) / (1 - share)) if c else 0.0)) if p > share else 0.0


def first_witnesses(t: Counter, c: Counter, toxic: int, clean: int) -> set[str]:
    share = toxic / max(1, toxic + clean)
    return {s for s, n in t.items() if n * clean >= RATIO * c[s] * toxic and evidence(n, c[s], share) >= EVIDENCE}


class TextScorer:
    """Counts the insulting spans of texts; remembers what it knows of words."""

    def __init__(self, machine: SpanMachine):
        self.machine = machine
        self.known: set[str] = set()
        self.bad: dict[str, tuple[int, float]] = {}
        self.sure: set[str] = set()

    def _learn(self, words: list[str]) -> None:
        parts = [spans_of_word(w) for w in words]
        flat = [s for p in parts for s in p]
        scores = self.machine.scores(flat)
        at = 0
        for w, p in zip(words, parts):
            if p:
                k = int(scores[at : at + len(p)].argmax())
                if not self.machine.sure.isdisjoint(p):
                    self.sure.add(w)
                if scores[at + k] > MARGIN or w in self.sure:
                    self.bad[w] = (int(self.machine.families([p[k]])[0]), float(scores[at + k]))
                at += len(p)
        self.known.update(words)

    def judge(self, texts: list[str | None]) -> list[tuple[float, str] | None]:
        """For each text None, or the surprise (minus the logarithm of the chance that clean text has so many insults) and its worst span."""
        lowered = [t.lower().split() if t else [] for t in texts]
        every = set().union(*lowered) if lowered else set()
        new = every - self.known
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.bad, self.sure = set(), {}, set()
            new = every
        self._learn(list(new))
        out = []
        for text, words in zip(texts, lowered):
            hits = [(w, *self.bad[w]) for w in words if w in self.bad] if not self.bad.keys().isdisjoint(words) else []
            sure = any(h[0] in self.sure for h in hits)
            joined = runs(text.lower()) if text and _SINGLES.search(text) else []
            if joined:
                for run in joined:  # a run is one hit, by its worst window
                    own = windows(run)
                    scores = self.machine.scores(own)
                    k = int(scores.argmax())
                    own_sure = not self.machine.sure.isdisjoint(own)
                    sure = sure or own_sure
                    if scores[k] > MARGIN or own_sure:
                        hits.append((own[k], int(self.machine.families([own[k]])[0]), float(scores[k])))
            best = self.machine.surprise([h[1:] for h in hits], len(words)) if hits else 0.0
            if sure:
                best = max(best, 1 - math.log(CHANCE))
            out.append((best, min(hits, key=lambda h: (-h[2], h[0]))[0]) if best > -math.log(CHANCE) else None)
        return out


def _flag(machine: SpanMachine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = TextScorer(machine)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = scorer.judge(batch.column(1).slice(at, 256).to_pylist())
                hit = [k for k, v in enumerate(found) if v is not None]
                if hit:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256).take(pa.array(hit)), pa.array([found[k][0] for k in hit], pa.float64()), pa.array([found[k][1] for k in hit], pa.string())], ["doc_id", "score", "span"])

    return run


def fit(texts: list[str], toxic: list[bool]) -> SpanMachine:
    """The machine and its witnesses, in turn until they agree (ROUNDS at most), then calibrated."""
    bad, good, t, c, clean, words = bags(texts, toxic)
    share = len(bad) / max(1, len(good))
    first = first_witnesses(t, c, len(bad), len(good))
    witnesses = Counter(s for own in bad for s in own if s in first)
    machine = SpanMachine.fit([], [])
    negative = list(clean)
    spans = list(t)
    for _ in range(ROUNDS):
        positive = sorted(witnesses, key=lambda s: (-witnesses[s], s))
        machine = SpanMachine.fit(positive, negative)
        if not positive:
            break
        score = dict(zip(spans, machine.scores(spans)))
        best = [max(own, key=lambda s: (score[s], s)) for own in bad if own]
        # A score is evidence, but spans that clean sentences have too, or chance explains, are none.
        new = Counter(s for s in best if score[s] > MARGIN and t[s] > RATIO * share * c[s] and evidence(t[s], c[s], share / (1 + share)) >= EVIDENCE / 2)
        if not new or new.keys() == witnesses.keys():
            break
        witnesses = new
    machine.calibrate(positive, {s: t[s] / (RATIO * max(share, 1e-9)) for s in positive}, clean, words)
    return machine


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> SpanMachine:
    """Trains on at most sample toxic and twice as many clean documents."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("kx_id")).agg((F.max("toxic") > 0).alias("kx_bad"))
    order = [F.xxhash64("kx_id", F.lit(4)), F.col("kx_id")]
    chosen = cut(known.where("kx_bad").orderBy(*order).limit(sample).unionByName(known.where("NOT kx_bad").orderBy(*order).limit(2 * sample)))
    ids = docs.select(quoted(id_col).alias("kx_id"), quoted(text_col).cast("string").alias("kx_text"))
    rows = join_checked(ids, chosen, ["kx_id"], "inner", 24).groupBy("kx_id", "kx_bad").agg(F.min("kx_text").alias("kx_text")).orderBy("kx_id").collect()
    return fit([r.kx_text for r in rows], [r.kx_bad for r in rows])


def toxic_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, span) of the documents that are toxic: how surprising their insults would be in clean text, and the worst of them."""
    machine = train(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.where(quoted(text_col).isNotNull()).select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    flagged = spread(rows).mapInArrow(_flag(machine), f"doc_id {dtype(docs, id_col)}, score double, span string")
    return flagged.select("doc_id", F.round("score", 6).alias("score"), "span")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
