"""Secret scan with structural confirmation.

Base kinds are patterns: ``assign`` (a named value), ``access`` (an access-key id) and ``hex`` (a
long hexadecimal run). The confirmed kinds are reported only if a candidate decodes and parses:
``jwt``, a signed token whose header is a JSON object with an algorithm and whose payload is JSON;
``key``, base64 or hex that decodes to a private key, either DER whose nested lengths add up and
whose fields are those of PKCS#1, PKCS#8, encrypted PKCS#8 or an EC key, or the OpenSSH format with
its length-prefixed fields; ``pem``, a private-key block whose body decodes to one of those, below
header lines or not. A body that its headers call encrypted can't be parsed; it is confirmed by
whole cipher blocks and an initial value in hexadecimal digits.

Spans are code-point offsets, end exclusive. A text is looked at whole; byte searches, one for
each kind or more, settle that most texts cannot hold it, and only the others are matched.

Defined cases: a null or empty text has no spans; every row is judged by itself, so repeated rows
and equal ids are no matter; an empty table gives an empty result; other columns are ignored,
whatever their names.
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

from quarry.llm._common import lean, small_batches, table

#: The base patterns, the least length of each, and the order of kinds.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "jwt", "key", "pem")

_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
#: Runs of token letters joined by dots; any three of its parts in a row may be a signed token.
_PARTS = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)+")
_ENCODED = re.compile(r"[A-Za-z0-9+/_-]{48,}={0,2}")
#: A block's body ends at the next five dashes, whatever they begin, so blocks are read once each.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9]++(?: [A-Z0-9]++)*+)-----((?:[A-Za-z0-9+/=\s:,]|-(?!----))*+)-----END \1-----")

_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_RUN = bytes(120 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-." else 32 for b in range(256))
_LONG = b"x" * 32
#: What every signed token holds, letter by letter: the end of the header, a dot, the start of the payload.
_PART = bytes(46 if chr(b) == "." else 120 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-" else 32 for b in range(256))
_DOTTED = b"x" * 8 + b".xx"

INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
#: How the identifiers of password-based encryption begin, and what headers say of an encrypted body.
ENCRYPTED = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")
_HEADERS = re.compile(r"\s*((?:[A-Za-z][A-Za-z0-9-]*+:[^\n]*+\n(?:[ \t]++\S[^\n]*+\n)*+)++)")
_INITIAL = re.compile(r"(?m)^DEK-Info:[ \t]*[A-Z0-9-]++,(?:[0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})[ \t\r]*$")


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each item, if their lengths fill ``data`` exactly; else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def private_der(data: bytes) -> bool:
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    fields = der_items(outer[0][1])
    if not fields:
        return False
    tags = [t for t, _ in fields]
    if tags == [SEQUENCE, OCTETS]:
        cipher = der_items(fields[0][1])
        return bool(cipher) and cipher[0][0] == OID and cipher[0][1].startswith(ENCRYPTED)
    if tags[0] != INTEGER:
        return False
    if len(tags) >= 9 and tags[:9] == [INTEGER] * 9:
        return True
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:
        algorithm = der_items(fields[1][1])
        return bool(algorithm) and algorithm[0][0] == OID
    return len(tags) >= 2 and tags[:2] == [INTEGER, OCTETS] and fields[0][1] == b"\x01"


def private_openssh(data: bytes) -> bool:
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    at, strings = len(magic), 0
    keys = 1
    while strings < 3 + keys + 1:
        if strings == 3:
            keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
            if not 1 <= keys <= 16:
                return False
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return False
        strings += 1
    return True


def decoded(run: str) -> bytes | None:
    body = re.sub(r"\s", "", run).rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def private_key(data: bytes | None) -> bool:
    return data is not None and (private_der(data) or private_openssh(data))


def private_block(body: str) -> bool:
    """Whether the body of a private-key block holds a key, below header lines if it begins with such."""
    headers = _HEADERS.match(body)
    data = decoded(body[headers.end() :] if headers else body)
    if headers and re.search(r"(?m)^Proc-Type:[ \t]*4,[ \t]*ENCRYPTED[ \t\r]*$", headers[1]):
        return bool(data) and len(data) % 8 == 0 and bool(_INITIAL.search(headers[1]))
    return private_key(data)


def signed_token(header: str, payload: str) -> bool:
    try:
        parsed = [json.loads(decoded(part) or b"") for part in (header, payload)]
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(parsed[0], dict) and isinstance(parsed[0].get("alg"), str) and isinstance(parsed[1], dict)


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost spans of header, payload and signature, none overlapping."""
    for run in _PARTS.finditer(text):
        parts, at, done = run[0].split("."), run.start(), 0
        for k in range(len(parts) - 2):
            size = len(parts[k]) + len(parts[k + 1]) + len(parts[k + 2]) + 2
            if k >= done and len(parts[k]) >= 8 and len(parts[k + 1]) >= 2 and signed_token(parts[k], parts[k + 1]):
                yield at, at + size
                done = k + 3
            at += len(parts[k]) + 1


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    small = data.lower()
    spans: list[tuple[str, int, int]] = []
    if any(n in small for n in _NAMES):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in data:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if _LONG in data.translate(_RUN):
        spans += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
        for m in _ENCODED.finditer(text):
            as_hex = bytes.fromhex(m[0]) if len(m[0]) % 2 == 0 and re.fullmatch("[0-9a-fA-F]+", m[0]) else None
            if private_key(as_hex) or private_key(decoded(m[0])):
                spans.append(("key", *m.span()))
    if b"." in data and _DOTTED in data.translate(_PART):
        spans += [("jwt", *s) for s in signed_tokens(text)]
    if b"-----BEGIN " in data:
        spans += [("pem", *m.span()) for m in _PEM.finditer(text) if m[1].endswith("PRIVATE KEY") and private_block(m[2])]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            spans = find(text.as_py())
            kinds = [s[0] for s in spans]
            base = [s for s in spans if s[0] in LEAST]
            digest = hashlib.sha256(told(base).encode()).hexdigest()
            rows.append((*(kinds.count(k) for k in LEAST), len(spans) - len(base), digest, told(spans)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        made = [pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *(f.split()[0] for f in SCHEMA.split(", "))])


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lean(_scan), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
