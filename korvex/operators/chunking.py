"""Windowed chunks with exact spans, and deterministic ids.

Windows of 1600 characters end at their last line end (if that is 400
characters in) or hard, overlap by 160, and are trimmed; each knows its
character, byte, token and line span and 120 characters of context on both
sides. The next start depends on the end before, so this runs as one Arrow pass
over whole documents; everything after it is built-in. Characters are code
points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korvex.functions.text import NEWLINES, SPACES, fnv1a_hex, normalize, stable_hash
from korvex.plans.util import spread

SIZE, OVERLAP, CONTEXT, LEAST = 1600, 160, 120, 400
CHUNKER, CHUNKER_VERSION = "text-window", "1"
_BREAK = re.compile(f"[{NEWLINES}]")
_TOKEN = re.compile(r"[^\W_]+")
_SPANS = ["character_start", "character_end", "byte_start", "byte_end", "token_start", "token_end", "line_start", "line_end"]


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """Effective [start, end) of each window of a normalised text."""
    n = len(text)
    start = 0
    while True:
        hard = min(start + size, n)
        end = hard
        if hard < n:
            at = max(text.rfind(c, start + least, hard) for c in NEWLINES)
            end = at if at >= 0 else hard
        piece = text[start:end]
        lead = len(piece) - len(piece.lstrip(SPACES))
        inner = piece.strip(SPACES)
        yield (start + lead, start + lead + len(inner)) if inner else (start, end)
        if end >= n:
            return
        step = end - min(overlap, end - start)
        start = step if step > start else end


def chunk_text(text: str) -> list[tuple]:
    """(ordinal, text, hash, the spans, context before, context after) of each window."""
    rows = spans_of(text)
    return [(*r[:2], h, *r[2:]) for r, h in zip(rows, hashes([r[1] for r in rows]))]


def hashes(texts: list[str]) -> list[str]:
    """Content hashes of windows; quick for many at once."""
    return fnv1a_hex([b"chunk\xff" + t.encode("utf-8", "surrogatepass") + b"\xff" for t in texts])


def spans_of(text: str, places: bool = True) -> list[tuple]:
    """(ordinal, text, the spans, context before, context after) of each window; without places, (ordinal, text)."""
    if not places:
        return [(k, text[a:b]) for k, (a, b) in enumerate(windows(text))] if text else [(0, "")]
    if not text:
        return [(0, "", 0, 0, 0, 0, 0, 0, 1, 1, "", "")]
    spans = list(windows(text))
    breaks = [m.start() for m in _BREAK.finditer(text)]
    starts, ends = [], []
    for m in _TOKEN.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    ascii_only = text.isascii()
    out, at, byte = [], 0, 0
    for k, (a, b) in enumerate(spans):
        body = text[a:b]
        if ascii_only:
            first = a
        else:  # windows overlap, so the distance from the one before may be negative
            byte += len(text[at:a].encode("utf-8", "surrogatepass")) if a >= at else -len(text[a:at].encode("utf-8", "surrogatepass"))
            at, first = a, byte
        size = len(body) if ascii_only else len(body.encode("utf-8", "surrogatepass"))
        # A token that the start splits counts to the offset and to the window's own.
        before = bisect_left(starts, a)
        own = bisect_left(starts, b) - bisect_right(ends, a)
        lines = bisect_left(breaks, a)
        out.append((k, body, a, b, first, first + size, before, before + own, 1 + lines, 1 + bisect_left(breaks, b), text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]))
    return out


_TEXTS = ("text", "content_hash", "context_before", "context_after")
#: Columns of a window, in the order of spans_of(), the hash after the text.
COLUMNS = ["ordinal", "text", "content_hash", *_SPANS, "context_before", "context_after", "occurrence"]
#: Characters of windows that a worker holds before it sends them on.
HELD = 1 << 21


def _chunker(columns: list[str]):
    """Rows (id, text, and others) to their windows, with the columns asked for and the others as they are."""
    places = bool({*_SPANS, "context_before", "context_after"} & {*columns})
    fields = [c for c in COLUMNS[:-1] if c != "content_hash"] if places else ["ordinal", "text"]

    def out(batch: pa.RecordBatch, at: list[int], rows: list[tuple], seen: list[int]) -> pa.RecordBatch:
        cols = dict(zip(fields, zip(*rows))) | {"occurrence": seen}
        if "content_hash" in columns:
            cols["content_hash"] = hashes(list(cols["text"]))
        index = pa.array(at, pa.int64())
        arrays = [pa.array(cols[c], pa.string() if c in _TEXTS else pa.int64()) for c in columns]
        own = [batch.column(k).take(index) for k in range(batch.num_columns) if k != 1]
        return pa.RecordBatch.from_arrays([own[0], *arrays, *own[1:]], ["document_id", *columns, *batch.schema.names[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, seen, size = [], [], [], 0
            for k, text in enumerate(batch.column(1)):
                equal: Counter = Counter()
                for row in spans_of(text.as_py() or "", places):
                    at.append(k)
                    rows.append(row)
                    if "occurrence" in columns:
                        seen.append(equal[row[1]])
                        equal[row[1]] += 1
                    size += len(row[1])
                if size > HELD:
                    yield out(batch, at, rows, seen)
                    at, rows, seen, size = [], [], [], 0
            if rows:
                yield out(batch, at, rows, seen)

    return run


def chunk(objects: DataFrame, id_col: str = "id", body_col: str = "body", columns: list[str] = COLUMNS, keep: Sequence[str] = ()) -> DataFrame:
    """The windows of every row's normalised body, with occurrence: how many equal windows came before in the document.

    columns: those to make, as hashes, spans and texts cost time and memory;
    keep: columns of objects that every window repeats, which saves a join.
    """
    kinds = dict(objects.dtypes)
    rows = spread(objects.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(body_col), F.lit("")).alias("body"), *keep))
    schema = ["document_id string", *[f"{c} {'string' if c in _TEXTS else 'bigint'}" for c in columns], *[f"{c} {kinds[c]}" for c in keep]]
    return rows.select("id", normalize(F.col("body")).alias("body"), *keep).mapInArrow(_chunker(list(columns)), ", ".join(schema))


def occurrences(chunks: DataFrame) -> DataFrame:
    """chunks with occurrence counted by a window: for chunks that come from elsewhere."""
    w = Window.partitionBy("document_id", "content_hash").orderBy("ordinal")
    return chunks.withColumn("occurrence", (F.row_number().over(w) - 1).cast("bigint"))


def with_ids(objects: DataFrame) -> DataFrame:
    """objects (id, type, title, body, representation_id) with normalised body and the ids derived from content."""
    out = objects.withColumn("body", normalize(F.coalesce(F.col("body"), F.lit(""))))
    out = out.withColumn("content_hash", stable_hash(F.lit("document"), F.col("type"), F.col("title"), F.col("body")))
    out = out.withColumn("version_id", F.concat("id", F.lit(":version:"), "content_hash"))
    out = out.withColumn("lineage_id", F.coalesce("representation_id", F.concat("id", F.lit(":representation:plainText"))))
    return out.withColumn("active_representation_id", F.concat("lineage_id", F.lit(":"), stable_hash(F.lit("representation"), F.col("body"))))


def chunk_ids(chunks: DataFrame, lineage: str = "lineage_id", policy: str = "policy_id", chunker: str = CHUNKER, version: str = CHUNKER_VERSION) -> DataFrame:
    """chunks with chunk_id: it depends on lineage, policy, chunker and text, but not on the ordinal.

    chunker: the name that enters the hash; that of another store gives its ids.
    """
    h = stable_hash(F.col(lineage), F.col(policy), F.lit("1"), F.lit(chunker), F.lit(version), F.col("occurrence"), F.col("content_hash"))
    return chunks.withColumn("chunk_id", F.concat("document_id", F.lit(":chunk:"), h))
