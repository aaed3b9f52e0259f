"""Secrets: patterns propose spans, and the structure of what they encode confirms them.

assign, access and hex are reported wherever their pattern and length hold. jwt, pem, der
and ssh are the method's own: the candidate is decoded from base64 or hex, and its token
header, key encoding or nested lengths must parse to the end before it is reported. Nothing
has a greatest length. A search passes a text once, and what it decodes is a candidate's own
characters once, or the few heads of a key, so time grows with the text.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re

from pyspark.sql import DataFrame, SparkSession

from .shared import dealt, table
from .spans import Span, digests

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
BASE = KINDS[:3]

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
# A head is a whole run of its letters, so each run is read once; the rest is only looked at.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)(?=(\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+))")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_HEADER = re.compile(r"[A-Za-z0-9-]+:")
_CIPHER = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,[0-9A-Fa-f]{16,}")
_DER64 = re.compile(r"(?<![A-Za-z0-9+/])M[A-I][A-Za-z0-9+/]{62,}={0,2}")
# Lines of base64 that follow one another; the first may begin a key.
_LINES64 = re.compile(r"(?<![A-Za-z0-9+/])M[A-I][A-Za-z0-9+/]{38,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/]++)++={0,2}")
_LINE_START = re.compile(r"\n[\x20\t]*(?=M[A-I])")
_DER16 = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{94,}")
_SSH = re.compile(r"b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/\s]{60,}={0,2}")
_SPACE = re.compile(r"\s+")
#: Elements that a private key's outer sequence has at most; multi-prime keys nest the rest.
_KEY_PARTS = 12


def b64(text: str, url: bool = False) -> bytes | None:
    text = _SPACE.sub("", text)
    try:
        text = text.rstrip("=")
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if url else None, validate=True)
    except (ValueError, binascii.Error):
        return None


def tlv(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, bytes]] | None:
    """The DER elements that fill data[at:end] exactly, else None."""
    end = len(data) if end is None else end
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
            if size < 0x80:
                return None
        if at + size > end:
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_private_key(data: bytes | None) -> bool:
    """PKCS#1, PKCS#8 (plain or encrypted) or SEC1, with nested lengths that add up."""
    outer = tlv(data) if data else None
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = tlv(outer[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if tags[:1] == [2] and len(inner) >= 9 and set(tags[:9]) == {2} and inner[0][1] in (b"\0", b"\1"):
        return True
    if tags[:3] == [2, 0x30, 4] and inner[0][1] in (b"\0", b"\1"):
        algorithm = tlv(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 6
    if tags[:2] == [2, 4] and inner[0][1] == b"\1" and 16 <= len(inner[1][1]) <= 80:
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags == [0x30, 4]:
        algorithm = tlv(inner[0][1])
        return bool(algorithm) and algorithm[0][0] == 6
    return False


def is_openssh_key(data: bytes | None) -> bool:
    magic = b"openssh-key-v1\0"
    if not data or not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):  # cipher, key derivation and its options
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 16


#: What '"alg"' is in base64, after a multiple of three bytes, and one and two more.
_ALG64 = ("ImFsZy", "JhbGci", "iYWxnI")
#: Characters of the shortest header, {"alg":""}.
_LEAST_HEAD = 14


def is_jwt(head: str, body: str) -> bool:
    """A header that names its algorithm, and claims; only what can be one is decoded."""
    if len(head) < _LEAST_HEAD or not any(a in head for a in _ALG64):
        return False
    try:
        header, claims = (json.loads(b64(x, url=True) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def _jwts(text: str) -> list[Span]:
    out, free = [], 0
    for m in _JWT.finditer(text):
        at = text.find("eyJ", m.start(), m.end())
        if at < max(free, m.start()):
            continue
        if is_jwt(text[at : m.end()], m.group(2)[1:].partition(".")[0]):
            free = m.end(2)
            out.append(Span(at, free, "jwt"))
    return out


def is_armoured(body: str) -> bool:
    """What stands between BEGIN and END: header lines, if any, then a key in base64. The key
    of a body with a cipher header is encrypted as a whole, in blocks of eight bytes."""
    body = body.replace("\\r", "\n").replace("\\n", "\n")  # escaped, as in JSON
    lines, heads = body.strip().split("\n"), 0
    while heads < len(lines) and _HEADER.match(lines[heads]):
        heads += 1
        while heads < len(lines) and lines[heads][:1] in (" ", "\t") and lines[heads].strip():
            heads += 1  # a header goes on
    data = b64("".join(lines[heads:]))
    if any(_CIPHER.match(x) for x in lines[:heads]):
        return bool(data) and len(data) >= 16 and len(data) % 8 == 0
    return is_openssh_key(data) or is_private_key(data)


def _pems(text: str) -> list[Span]:
    """From each BEGIN to the next dashes, which must be its END; a body of any length."""
    out = []
    for m in _BEGIN.finditer(text):
        stop, end = text.find("-----", m.end()), f"-----END {m.group(1)}-----"
        if stop >= 0 and text.startswith(end, stop) and is_armoured(text[m.end() : stop]):
            out.append(Span(m.start(), stop + len(end), "pem"))
    return out


def _part(chars: str, at: int, first: int, size: int) -> bytes:
    """Some bytes of what the base64 at a place encodes, without decoding the rest."""
    quads = chars[at + first // 3 * 4 : at + (first + size + 2) // 3 * 4]
    try:
        return base64.b64decode(quads + "=" * (-len(quads) % 4))[first % 3 : first % 3 + size]
    except (ValueError, binascii.Error):
        return b""


def _head(chars: str, at: int, first: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the element at a byte of what the base64 at a place encodes."""
    raw = _part(chars, at, first, 6)
    if len(raw) < 2:
        return None
    n = raw[1] & 0x7F if raw[1] & 0x80 else 0
    if n > 4 or raw[1] == 0x80 or len(raw) < 2 + n:
        return None
    size = int.from_bytes(raw[2 : 2 + n], "big") if n else raw[1]
    return raw[0], first + 2 + n, first + 2 + n + size


def _elements(chars: str, at: int, first: int, end: int) -> list[tuple[int, int, int]] | None:
    """The few elements that fill a range of bytes exactly, each as tag, start and end; they are
    followed from head to head, and what lies between is not decoded."""
    out = []
    while first < end and len(out) < _KEY_PARTS:
        found = _head(chars, at, first)
        if not found or found[2] > end:
            return None
        out.append(found)
        first = found[2]
    return out if first == end else None


def key_extent(chars: str, at: int) -> int | None:
    """How many characters a private key takes whose base64 begins at a place, if one does. It is
    what ``is_private_key`` accepts, but only heads are decoded, so the work for a place is
    bounded whatever the lengths say."""
    outer = _head(chars, at, 0)
    if not outer or outer[0] != 0x30:
        return None
    took = (outer[2] * 4 + 2) // 3
    inner = _elements(chars, at, outer[1], outer[2]) if at + took <= len(chars) else None
    if not inner:
        return None
    tags = [t for t, _, _ in inner]
    value = lambda i, most: _part(chars, at, inner[i][1], min(inner[i][2] - inner[i][1], most))

    def algorithm(i: int) -> bool:
        parts = _elements(chars, at, inner[i][1], inner[i][2])
        return bool(parts) and parts[0][0] == 6

    version = value(0, 2)
    rsa = len(tags) >= 9 and set(tags[:9]) == {2} and version in (b"\0", b"\1")
    pkcs8 = tags[:3] == [2, 0x30, 4] and version in (b"\0", b"\1") and algorithm(1)
    sec1 = tags[:2] == [2, 4] and version == b"\1" and 16 <= inner[1][2] - inner[1][1] <= 80 and all(t in (0xA0, 0xA1) for t in tags[2:])
    encrypted = tags == [0x30, 4] and algorithm(0)
    return took if rsa or pkcs8 or sec1 or encrypted else None


def _wrapped(text: str) -> list[Span]:
    """Keys in lines of base64 without armour. A key's own lengths say where it ends, so words
    on the lines after it don't matter."""
    out = []
    for m in _LINES64.finditer(text):
        places = [i for i in range(m.start(), m.end()) if not text[i].isspace()]
        chars = "".join(text[i] for i in places)
        starts = [m.start(), *(x.end() for x in _LINE_START.finditer(text, m.start(), m.end()))]
        free = 0
        for at in (bisect.bisect_left(places, i) for i in starts):
            if at < free or not (took := key_extent(chars, at)):
                continue
            end = at + took
            free = end
            while end < len(chars) and chars[end] == "=":
                end += 1
            if "\n" in text[places[at] : places[end - 1]]:  # those of one line are found as they are
                out.append(Span(places[at], places[end - 1] + 1, "der"))
    return out


def find(text: str) -> list[Span]:
    """All spans of a text, unsorted; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [Span(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [Span(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [Span(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if "eyJ" in text:
        out += _jwts(text)
    if "-----BEGIN" in text:
        out += _pems(text)
    if "M" in text:
        out += [Span(m.start(), m.end(), "der") for m in _DER64.finditer(text) if is_private_key(b64(m.group()))]
        if "\n" in text:
            out += _wrapped(text)
    if "30" in text:
        for m in _DER16.finditer(text):
            digits = m.group()
            if is_private_key(bytes.fromhex(digits[: len(digits) // 2 * 2])):
                out.append(Span(m.start(), m.end(), "der"))
    if "b3BlbnNzaC1rZXktdjE" in text:
        out += [Span(m.start(), m.end(), "ssh") for m in _SSH.finditer(text) if is_openssh_key(b64(m.group()))]
    return out


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty and have no spans; repeated rows are judged each for itself, and
    an empty table gives no rows. A text is searched whole whatever its length. Spans of one
    start go by kind. Only doc_id and text are read, so other columns can't clash."""
    return digests(dealt(table(spark, sf_dir, "documents")), find, KINDS, BASE)
