"""Token counts of a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton enumerates all vocabulary matches of a text; dynamic
programming over end positions carries the best score and its number of
pieces. Ties go, as in the tokenizer, to the candidate that begins first; a
character that no single-character piece covers costs the lowest score less
10, and stands for its UTF-8 bytes.

No piece of the vocabulary has a space mark behind another character, so the
best segmentation of a text is those of its words one after another, exactly;
a worker remembers the counts of words that it has met.

Defined results: a null text has a null count, an empty one 0; texts of any
length are counted whole; rows that repeat are all counted; no rows in give no
rows; ids may be null or of any type; other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvex.plans.util import quoted, spread, table

#: Folder of the vocabulary files, and the one whose pieces and scores are the unigram model.
FOLDER = "/opt/tokenizers"
VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
PENALTY = 10.0
#: Characters of the words whose counts a worker remembers, in all; longer words than LONG are counted anew.
REMEMBERED, LONG = 1 << 22, 64
_BYTE = re.compile(r"<0x[0-9A-F]{2}>")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), float(model.get_score(k))) for k in range(model.get_piece_size())]


class PieceCounter:
    """Counts pieces of texts."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.inner = any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        # Without all byte pieces an unknown run is one piece.
        self.bytes = sum(1 for p, _ in pieces if _BYTE.fullmatch(p)) == 256
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")
        self.known: dict[str, int] = {}
        self.held = 0

    def viterbi(self, text: str) -> int:
        """Pieces of the best segmentation of a normalised text."""
        n = len(text)
        best = [None] * (n + 1)
        count = [0] * (n + 1)
        run = [False] * (n + 1)  # ends in an unknown character
        best[0] = 0.0
        done = 0

        def unknown(end: int) -> None:
            start = end - 1
            if text[start] in self.single or best[start] is None:
                return
            score = best[start] + self.unknown
            if best[end] is None or score > best[end]:
                best[end] = score
                if self.bytes:
                    count[end] = count[start] + len(text[start].encode("utf-8", "surrogatepass"))
                else:
                    count[end] = count[start] + (not run[start])
                run[end] = True

        for last, (length, score) in self.automaton.iter(text):
            end = last + 1
            while done < last:  # ends before this one are complete but for their unknown character
                done += 1
                unknown(done)
            start = end - length
            if best[start] is None:
                continue
            total = best[start] + score
            if best[end] is None or total > best[end]:
                best[end], count[end], run[end] = total, count[start] + 1, False
        while done < n:
            done += 1
            unknown(done)
        return count[n]

    def count(self, text: str | None) -> int | None:
        if text is None:
            return None
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if self.inner:
            return self.viterbi(text)
        known = self.known
        total = 0
        for word in self.words.findall(text):
            c = known.get(word)
            if c is None:
                c = self.viterbi(word)
                if len(word) <= LONG:
                    if self.held > REMEMBERED:
                        known.clear()
                        self.held = 0
                    known[word] = c
                    self.held += len(word)
            total += c
        return total


def counter(path: str | None = None):
    """A column function: text to its number of tokens. path: of the vocabulary file, which every executor can read."""
    pieces = vocabulary(path or f"{FOLDER}/{VOCABULARY}")

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = PieceCounter(pieces)
        for texts in batches:
            yield pa.array([own.count(t.as_py()) for t in texts], pa.int64())

    return count


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row."""
    rows = spread(docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text")))
    return rows.select("doc_id", counter(path)(F.col("text")).alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
