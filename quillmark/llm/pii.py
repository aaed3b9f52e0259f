"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Kinds: email, ip, card (Luhn) and phone are reported wherever their pattern and check hold,
whatever their score. iban (mod-97), ssn and local_phone are the method's own: they are
reported from ``REPORTED`` on. A kind's score starts from a prior, which is high where a
checksum or a rare form confirms it, and words nearby raise or lower it.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dealt, small_batches, table
from .spans import Span, digests

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
BASE = KINDS[:4]
REPORTED = 0.7
#: Code points on either side in which context words count.
CONTEXT = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digits of a run are never given back: a match can start at a run's first digit only.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.\x28-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")

PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "local_phone": 0.4}
_WORDS = {
    "email": ("email", "mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "server", "host", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "llame", "appel"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "ssn": ("ssn", "social security", "sozialversicherung", "seguridad social"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "llame", "appel"),
}
_NEAR = {kind: re.compile(rf"\b(?:{'|'.join(words)})\b") for kind, words in _WORDS.items()}
_AGAINST = ("order", "invoice", "version", "isbn", "serial", "example")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def context_score(text: str, start: int, end: int, kind: str, prior: float) -> float:
    near = (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower()
    words = re.findall(r"\w+(?:\x20security|\x20social)?", near)
    joined = " ".join(words)
    score = prior
    if _NEAR[kind].search(joined):
        score += 0.35
    if any(w in words for w in _AGAINST):
        score -= 0.25
    return max(0.0, min(1.0, score))


def _span(text: str, start: int, end: int, kind: str) -> Span:
    return Span(start, end, kind, context_score(text, start, end, kind, PRIOR[kind]))


def _emails(text: str) -> list[Span]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from
    the at signs outwards, so that a long run of letters is walked once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(_span(text, start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def find(text: str) -> list[Span]:
    """All spans of a text, unsorted; code points, end exclusive."""
    out = _emails(text)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(_span(text, *m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(_span(text, *m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(_span(text, *m.span(), "phone"))
    for m in _IBAN.finditer(text):
        code = m.group().replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            out.append(_span(text, *m.span(), "iban"))
    for m in _SSN.finditer(text):
        a, b, c = m.group().split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            out.append(_span(text, *m.span(), "ssn"))
    for m in _LOCAL_PHONE.finditer(text):
        out.append(_span(text, *m.span(), "local_phone"))
    return [s for s in out if s.score >= REPORTED or s.kind in BASE]


def redact(text: str) -> str:
    """Every span replaced by its kind in brackets; overlapping ones by the first's."""
    spans = sorted(find(text), key=lambda s: (s.start, -s.end, KINDS.index(s.kind)))
    out, at = [], 0
    for i, s in enumerate(spans):
        if s.start < at:
            if s.end > at:
                at = s.end
            continue
        out += [text[at : s.start], f"[{s.kind}]"]
        at = s.end
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with personal data taken out of ``text``; a null text stays null. Only texts
    that change are new; n_chars, if there, follows them."""
    @F.pandas_udf("string")
    def cleaned(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else redact(t))

    names = columns or docs.columns
    out = small_batches(docs).withColumn("text", cleaned("text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in names])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty and have no spans; repeated rows are judged each for itself, and
    an empty table gives no rows. A text is searched whole whatever its length. Spans of one
    start go by kind. Only doc_id and text are read, so other columns can't clash."""
    return digests(dealt(table(spark, sf_dir, "documents")), find, KINDS, BASE, scores=True)
