"""Text functions: normalisation, tokens, literal matching, stable hashes, stems."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Characters that end a line once carriage returns are gone.
NEWLINES = "\n\x0b\x0c\x85\u2028\u2029"
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nfc(text: Column) -> Column:
    """Canonical composition by the ICU library that Spark ships, so that no text goes to Python; ASCII texts and nulls stay as they are."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(F.octet_length(text) > F.char_length(text), composed).otherwise(text)


@F.arrow_udf(StringType())
def fold(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Without case and diacritics, of the same length wherever each character's own form has one character."""
    for texts in batches:
        yield pa.array([None if v is None else fold_text(v) for v in texts.to_pylist()], pa.string())


def fold_text(text: str) -> str:
    if text.isascii():
        return text.lower()
    out = []
    for c in text:
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)).lower() or c
        base = "".join(x for x in base if not unicodedata.combining(x)) or c
        out.append(base if len(base) == 1 else c.lower()[:1])  # positions stay those of the text
    return "".join(out)


def trim(text: Column) -> Column:
    """Without white space and line ends at both ends."""
    return F.btrim(text, F.lit(SPACES))


def normalize(text: Column) -> Column:
    """Line feeds only, composed characters, trimmed."""
    lines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return trim(nfc(F.when(F.contains(text, F.lit("\r")), lines).otherwise(text)))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def ascii_lower(text: Column) -> Column:
    """Lower case of ASCII letters alone, as LIKE and lower() of an SQL store fold."""
    return F.translate(text, _UPPER, _LOWER)


def contains_literal(text: Column, needle: Column) -> Column:
    """Whether text has needle, whose % and _ mean themselves; ASCII letters match in either case."""
    return F.contains(ascii_lower(text), ascii_lower(needle))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# Stable hashes

_BASIS, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(rows: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a of every row; the rows advance byte by byte together."""
    n = len(rows)
    h = np.full(n, _BASIS, np.uint64)
    if not n:
        return h
    size = np.fromiter(map(len, rows), np.int64, n)
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(rows), np.uint8).astype(np.uint64)
    start = (np.cumsum(size) - size)[order]
    active = np.searchsorted(-size[order], -np.arange(int(size.max())), side="left")
    own, prime = np.full(n, _BASIS, np.uint64), np.uint64(_PRIME)
    for k, m in enumerate(active):
        own[:m] = (own[:m] ^ data[start[:m] + k]) * prime
    h[order] = own
    return h


def fnv1a_hex(rows: list[bytes]) -> list[str]:
    """Lower-case hexadecimal without leading zeros."""
    return [format(int(x), "x") for x in fnv1a(rows)]


@F.arrow_udf(StringType())
def _fnv(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for rows in batches:
        yield pa.array(fnv1a_hex([r or b"" for r in rows.to_pylist()]), pa.string())


def stable_hash(*parts: Column) -> Column:
    """Hash of several texts, each ended by a byte 255 (which no UTF-8 text has), so ("ab", "c") isn't ("a", "bc"); nulls are empty."""
    ended = [x for p in parts for x in (F.encode(F.coalesce(p.cast("string"), F.lit("")), "utf-8"), F.unhex(F.lit("FF")))]
    return _fnv(F.concat(*ended))


# Stems, as a full-text index with the Porter stemmer over folded words has them


def fold_term(term: str) -> str:
    """Lower case without diacritics of single letters."""
    if term.isascii():
        return term.lower()
    out = []
    for c in term.lower():
        d = unicodedata.normalize("NFD", c)
        out.append(d[0] if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:]) else c)
    return "".join(x for x in out if not unicodedata.combining(x))


def _vowels(word: str) -> str:
    """v or c for each letter."""
    kinds = ""
    for k, c in enumerate(word):
        kinds += "v" if c in "aeiou" or (c == "y" and k and kinds[-1] == "c") else "c"
    return kinds


def _measure(stem: str) -> int:
    return _vowels(stem).count("vc")


def _short(stem: str) -> bool:
    return _vowels(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(r.split(":")) for r in text.split()), key=lambda r: -len(r[0]))


_RULES2, _RULES3, _RULES4 = _rules(_STEP2), _rules(_STEP3), sorted(_STEP4.split(), key=lambda s: -len(s))


def porter(term: str) -> str:
    """The stem of a folded word by Porter's algorithm; words under 3 and over 64 bytes stay as they are."""
    raw = term.encode("utf-8", "surrogatepass")
    if not 3 <= len(raw) <= 64:
        return term
    w = raw.decode("latin-1")  # letters beyond ASCII count as consonants
    if w.endswith("s") and not w.endswith("ss"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and "v" in _vowels(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _vowels(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _vowels(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _vowels(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_RULES2, _RULES3):
        for suffix, new in rules:
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + new
                break
    for suffix in _RULES4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w.encode("latin-1").decode("utf-8", "surrogatepass")


@F.arrow_udf(ArrayType(StringType()))
def stems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Folded stems of arrays of words; a worker remembers those that it has met."""
    known: dict[str, str] = {}
    for lists in batches:
        out = []
        for words in lists.to_pylist():
            if words is None:
                out.append(None)
                continue
            if len(known) > 1 << 19:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = porter(fold_term(w))
            out.append([known[w] for w in words])
        yield pa.array(out, pa.list_(pa.string()))


# Content types

_MARKDOWN, _JSON = "net.daringfireball.markdown", "public.json"
#: Types that a type system knows; others are judged by their name.
_CODE = ["public.source-code", "public.swift-source", "public.python-script", "public.c-source", "public.c-header", "public.shell-script", "public.script", "public.java-source", "com.netscape.javascript-source"]
_TEXT = ["public.plain-text", "public.utf8-plain-text", "public.text", "public.html", "public.xml", "public.rtf"]


def representation_kind(content_type: Column) -> Column:
    """markdown, structuredJSON, code or plainText."""
    known = F.when(content_type == _MARKDOWN, "markdown").when(content_type == _JSON, "structuredJSON").when(content_type.isin(_CODE), "code")
    return known.when(~content_type.isin(_TEXT) & F.contains(content_type, F.lit("json")), "structuredJSON").otherwise("plainText")


def is_text_like(content_type: Column) -> Column:
    known = content_type.isin([_MARKDOWN, _JSON, *_CODE, *_TEXT])
    return F.coalesce(known | content_type.startswith("text/") | F.contains(content_type, F.lit("text")), F.lit(False))


_TYPES = {"md": "net.daringfireball.markdown", "markdown": "net.daringfireball.markdown", "json": "public.json", "py": "public.python-script", "swift": "public.swift-source", "c": "public.c-source", "h": "public.c-header", "js": "com.netscape.javascript-source", "sh": "public.shell-script", "txt": "public.plain-text", "html": "public.html", "htm": "public.html", "pdf": "com.adobe.pdf", "png": "public.png", "jpg": "public.jpeg"}


def path_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def content_type_of(path: Column) -> Column:
    """From the extension; data that nothing is known of otherwise."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv]), path_extension(path)), F.lit("public.data"))
