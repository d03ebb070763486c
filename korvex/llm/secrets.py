"""Secret scans with structural confirmation.

Runs of base64 or hex characters are only candidates. Each is decoded and has
to parse before it is reported: key encodings by their nested lengths (DER:
RSA, EC and PKCS#8 private keys, plain or encrypted; the OpenSSH container),
signed tokens by their JSON header, payload and a signature as long as the
header's algorithm makes it. A value without inner structure is reported only
where it is assigned to the name of a credential and decodes to bytes that
look random and are as many as a key or digest has.

Public keys, certificates, plain hashes and prose are not reported.

Defined results: null and empty texts give no rows; a secret found twice in a
text gives two rows; rows that repeat are all reported; positions count
characters, and a digest stands for the secret itself; texts of any length are
scanned whole; no rows in give no rows; ids may be null or of any type; other
columns may have any names and types.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvex.llm.ids import dtype
from korvex.plans.util import quoted, spread, table

_CANDIDATE = re.compile(r"(?:[A-Za-z0-9+/]{40,}\r?\n)+[A-Za-z0-9+/]+={0,2}|[A-Za-z0-9+/_-]{16,}(?:\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*|={0,2})")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----((?:[A-Za-z0-9+/=\s\"',]|\\[nr])+)-----END ")
_GAP = re.compile(r"(?:\\[nr]|[\s\"',])+")
_NAMED = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|credential|(?:api|access|private|auth|client|encryption|signing)[ _.-]?(?:key|token|secret))[\"']?[ \t]*(?::=|=>|[:=])\s*[\"']?$", re.IGNORECASE)
_HEX = re.compile(r"(?:[0-9a-f]{2})+|(?:[0-9A-F]{2})+")
_SIGNATURE = {"HS256": {32}, "HS384": {48}, "HS512": {64}, "ES256": {64}, "ES256K": {64}, "ES384": {96}, "ES512": {132}, "EdDSA": {64, 114}}
#: Bytes of an assigned value, and characters before it that may hold its name.
_KEY_BYTES, _BEFORE = range(15, 257), 160
_PRIVATE_OIDS = {bytes.fromhex("2a864886f70d010101"): "rsa", bytes.fromhex("2a8648ce3d0201"): "ec", bytes.fromhex("2b6570"): "ed25519", bytes.fromhex("2b656e"): "x25519", bytes.fromhex("2a8648ce380401"): "dsa"}


def unbase64(s: str) -> bytes | None:
    """Strictly decoded; both alphabets, padding may be missing."""
    s = s.replace("\r", "").replace("\n", "").rstrip("=")
    if len(s) % 4 == 1 or (("+" in s or "/" in s) and ("-" in s or "_" in s)):
        return None
    try:
        return base64.b64decode(s.replace("-", "+").replace("_", "/") + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, begin, end) of the DER values that fill data[at:end] exactly, or None."""
    end = len(data) if end is None else end
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if tag & 31 == 31:
            return None
        if size & 128:
            n = size & 127
            if not 1 <= n <= 4 or at + n > end or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 128:
                return None
            at += n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def key_kind(data: bytes) -> str | None:
    """The kind of private key that data encodes, by its nested lengths."""
    if data.startswith(b"openssh-key-v1\0"):
        at, parts = 15, []
        for _ in range(3):  # cipher, key derivation, its options
            if at + 4 > len(data):
                return None
            n = int.from_bytes(data[at : at + 4], "big")
            parts.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        if at + 4 > len(data):
            return None
        keys = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if not 1 <= keys <= 16:
            return None
        for _ in range(keys + 1):  # public keys, then the private block
            if at + 4 > len(data):
                return None
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return ("openssh_private_key" if parts[0] == b"none" else "openssh_encrypted_key") if at == len(data) else None
    if len(data) < 16 or data[0] != 0x30:
        return None
    top = der(data)
    if not top or len(top) != 1:
        return None
    inner = der(data, *top[0][1:])
    if not inner:
        return None
    tags = [t for t, _, _ in inner]
    value = lambda k: data[inner[k][1] : inner[k][2]]
    if len(tags) >= 9 and set(tags[:9]) == {2} and value(0) in (b"\0", b"\1") and len(value(1)) >= 48:
        return "rsa_private_key"
    if len(tags) == 6 and set(tags) == {2} and value(0) == b"\0" and len(value(1)) >= 64:
        return "dsa_private_key"
    if tags[:2] == [2, 4] and value(0) == b"\1" and 20 <= len(value(1)) <= 66:
        return "ec_private_key"
    if tags[:3] == [2, 0x30, 4] and value(0) in (b"\0", b"\1"):
        algorithm = der(data, *inner[1][1:])
        if algorithm and algorithm[0][0] == 6:
            name = _PRIVATE_OIDS.get(data[algorithm[0][1] : algorithm[0][2]])
            if name and (name in ("ed25519", "x25519", "dsa") or der(data, *inner[2][1:])):
                return f"pkcs8_{name}_private_key"
    if tags == [0x30, 4]:
        algorithm = der(data, *inner[0][1:])
        if algorithm and [t for t, _, _ in algorithm] == [6, 0x30] and data[algorithm[0][1] : algorithm[0][2]].startswith(bytes.fromhex("2a864886f70d0105")):
            return "pkcs8_encrypted_key"
    return None


def signed_token(text: str) -> str | None:
    """A signed token: JSON header with an algorithm, JSON payload, a signature that fits."""
    head, payload, signature = text.split(".")
    parsed = []
    for part in (head, payload):
        raw = unbase64(part)
        try:
            parsed.append(json.loads(raw.decode("utf-8")) if raw is not None else None)
        except (ValueError, RecursionError):
            return None
    if not all(isinstance(p, dict) for p in parsed) or not isinstance(parsed[0].get("alg"), str):
        return None
    algorithm, raw = parsed[0]["alg"], unbase64(signature) if signature else b""
    if raw is None:
        return None
    fits = len(raw) in _SIGNATURE[algorithm] if algorithm in _SIGNATURE else len(raw) >= 128 if algorithm[:2] in ("RS", "PS") else algorithm == "none" and not raw
    return f"signed_token_{algorithm.lower()}" if fits else None


def random_bytes(data: bytes) -> bool:
    """Whether data has as many bytes as a key, and about as many different ones as random bytes have."""
    n = len(data)
    return n in _KEY_BYTES and len(set(data)) >= 0.8 * 256 * (1 - (255 / 256) ** n) and not data.isascii()


def random_letters(s: str) -> bool:
    """Whether a text of letters alone changes between capitals and others as random ones do; words and joined words don't."""
    upper = [c.isupper() for c in s]
    return 0.25 <= sum(upper) / len(s) <= 0.75 and sum(a != b for a, b in zip(upper, upper[1:])) >= 0.36 * len(s)


def confirm(text: str, begin: int, end: int) -> tuple[str, int] | None:
    """The kind of secret that a candidate is, and where it ends; None if it is none."""
    s = text[begin:end]
    kind = None
    if "." in s:
        kind = signed_token(s)
        if kind is None:
            s = s[: s.index(".")]
    if kind is None:
        hexed = _HEX.fullmatch(s)
        forms = [bytes.fromhex(s)] if hexed else []
        # A DER sequence begins with byte 30, so with an M; an OpenSSH container with its name, so with a b.
        if s[0] in "Mb" and (plain := unbase64(s)) is not None:
            forms.append(plain)
        kind = next((k for k in map(key_kind, forms) if k), None)
        if kind is None and (random_letters(s) if s.isalpha() else any(c.isdigit() for c in s) or not s.isascii() or any(c in "+/" for c in s)) and _NAMED.search(text, max(0, begin - _BEFORE), begin):
            data = bytes.fromhex(s) if hexed else unbase64(s)
            if data is not None and random_bytes(data):
                kind = "assigned_hex_token" if hexed else "assigned_base64_token"
    return (kind, begin + len(s)) if kind else None


def key_bytes(data: bytes) -> int | None:
    """Bytes of the key encoding that data begins with, by its own lengths; None if data is too short for them."""
    if data.startswith(b"openssh-key-v1\0"):
        at, left, counted = 15, 3, False  # cipher, key derivation, its options; then as many blocks as keys, and the private one
        while left:
            if at + 4 > len(data):
                return None
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            left -= 1
            if not left and not counted:
                keys, counted = int.from_bytes(data[at : at + 4], "big"), True
                if not 1 <= keys <= 16:
                    return None
                at, left = at + 4, keys + 1
        return at
    if len(data) < 6 or data[0] != 0x30:
        return None
    n = data[1] & 127 if data[1] & 128 else 0
    return 2 + n + (int.from_bytes(data[2 : 2 + n], "big") if n else data[1]) if n <= 4 else None


def scan_lines(text: str, begin: int, end: int) -> tuple[list[tuple[str, int, int]], int]:
    """(kind, begin, end) of the secrets of a run of lines, and where the scan goes on.

    The last line may be no more than the first word of what follows, so
    shorter runs and lines by themselves are tried where the whole is nothing.
    """
    run = text[begin:end]
    starts = [begin, *(begin + m.end() for m in re.finditer("\n", run))]
    lines = [x.rstrip("\r") for x in run.split("\n")]
    total = [0]
    for x in lines:
        total.append(total[-1] + len(x.rstrip("=")))
    number = {n: k for k, n in enumerate(total)}
    ends = text.find("\n", end)
    alone = not text[end : ends if ends >= 0 else len(text)].strip(" \t\r\"',;")
    found, k = [], 0
    while k < len(lines):
        if lines[k][0] in "Mb":
            # As many characters as the key's own lengths ask for; they have to end a line.
            head = "".join(lines[k:]) if lines[k].startswith("b3Bl") else lines[k]
            head = head.rstrip("=")
            data = unbase64(head[: len(head) // 4 * 4])
            size = key_bytes(data) if data else None
            last = number.get(total[k] + -(-size * 4 // 3), 0) if size else 0
            if last > k:
                plain = unbase64("".join(lines[k:last]))
                kind = key_kind(plain) if plain is not None else None
                if kind:
                    found.append((kind, starts[k], starts[last - 1] + len(lines[last - 1])))
                    k = last
                    continue
        if k == len(lines) - 1:
            return found, starts[k]
        if k == 0 and alone and not _HEX.fullmatch(lines[0]) and (hit := confirm(text, begin, end)):
            return [(hit[0], begin, hit[1])], end
        if hit := confirm(text, starts[k], starts[k] + len(lines[k])):
            found.append((hit[0], starts[k], hit[1]))
        k += 1
    return found, end


def marked(text: str) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of the keys between PEM marks, their lines joined over line ends (written out too), spaces and quotes."""
    out = []
    for m in _PEM.finditer(text) if "PRIVATE KEY-----" in text else ():
        parts, at = [], m.start(1)
        for gap in _GAP.finditer(text, *m.span(1)):
            if gap.start() > at:
                parts.append((at, gap.start()))
            at = gap.end()
        if at < m.end(1):
            parts.append((at, m.end(1)))
        plain = unbase64("".join(text[x:y] for x, y in parts))
        kind = key_kind(plain) if plain else None
        if kind:
            out.append((kind, parts[0][0], parts[-1][1]))
    return out


def scan(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, begin, end, digest) of the secrets of a text, in order."""
    found, at = [], 0
    if not text:
        return found
    for kind, begin, end in [*marked(text), (None, len(text), len(text))]:
        hits = []
        while m := _CANDIDATE.search(text, at, begin):
            at = m.end()
            if "\n" in m.group():
                own, at = scan_lines(text, *m.span())
                hits += own
            elif hit := confirm(text, *m.span()):
                hits.append((hit[0], m.start(), hit[1]))
                at = hit[1]
            elif "." in m.group():  # what follows the dot may be a candidate itself
                at = m.start() + m.group().index(".") + 1
        if kind:
            hits.append((kind, begin, end))
            at = end
        found += [(k, x, y, hashlib.sha256(text[x:y].encode()).hexdigest()[:16]) for k, x, y in hits]
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, *hit) for k, text in enumerate(batch.column(1)) for hit in scan(text.as_py())]
        if rows:
            at, kind, begin, end, digest = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(kind), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(digest)], ["doc_id", "kind", "begin", "end", "digest"])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, begin, end, digest) of every confirmed secret."""
    rows = docs.where(quoted(text_col).isNotNull()).select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(_scan, f"doc_id {dtype(docs, id_col)}, kind string, begin bigint, end bigint, digest string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
