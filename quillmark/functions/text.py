"""Text expressions: cleaning of documents, sentences, tails, phrases.

Patterns use Java's Unicode classes, so that white space and word characters are those of
all scripts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmark import schema as S

_ANY = r"(?U)"
SENTENCE_END = r"(?U)(?<=[.!?])\s+|\n+"
URL = r"(?U)(https?://\S+|www\.\S+)"
MENTION = r"(?U)@\w+"
REVEAL = "(?iu)" + f"({S.SELF_REVEAL})"


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition, for which Spark has no built-in; texts with other than ASCII letters
    go through Arrow, all others stay where they are."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_nfc(F.when(other, text)), text)


def fold_apostrophe(text: Column) -> Column:
    return F.translate(text, "\u2019", "'")


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    # Single spaces, nearly all there is, need no replacing; after it only spaces are at the ends.
    return F.trim(F.regexp_replace(text, _ANY + r" \s+|[^\S ]\s*", " "))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def clean_document(text: Column, composed: bool = False) -> Column:
    """struct(text, reason, excised): the cleaned text, or null and why it was rejected.

    Sentences that reveal a language model go first, then urls and mentions; what is left
    needs 20 code points. ``composed``: the text is in NFC already, so no Python runs.
    """
    raw = text if composed else nfc(text)

    def told(cut: Column, hit: Column, cleaned: Column) -> Column:
        reason = (
            F.when(text.isNull() | (text == ""), S.REASON_EMPTY)
            .when(hit & ~cut.rlike(_ANY + r"\S"), S.REASON_NOTHING_LEFT)
            .when(F.char_length(cleaned) < S.MIN_CHARS, F.concat(F.when(hit, S.EXCISED_PREFIX).otherwise(""), F.lit(S.REASON_SHORT)))
        )
        return F.struct(F.when(reason.isNull(), cleaned).alias("text"), reason.alias("reason"), hit.alias("excised"))

    def judged(c: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(c["cut"], URL, " "), MENTION, " ")
        return bound(collapse(bare), lambda cleaned: told(c["cut"], c["hit"], cleaned))

    def excised(raw: Column) -> Column:
        kept = F.array_join(F.filter(sentences(raw), lambda s: s.rlike(_ANY + r"\S") & ~s.rlike(REVEAL)), " ")
        return bound(_reveals(raw), lambda hit: bound(F.struct(F.when(hit, kept).otherwise(raw).alias("cut"), hit.alias("hit")), judged))

    return bound(raw, excised)


def _reveals(text: Column) -> Column:
    """Whether a text reveals a language model. One of ASCII letters alone is only searched by the
    pattern if it has a part of one of its phrases; other letters may fold to those."""
    low = F.lower(text)
    may = (F.octet_length(text) != F.char_length(text)) | reduce(or_, (F.contains(low, F.lit(p)) for p in ("ai language model", "sorry", "i cannot ", " polic")))
    return F.coalesce(may & text.rlike(REVEAL), F.lit(False))


def strip_truncated_tail(text: Column) -> Column:
    """struct(text, cut): a final ellipsis goes with the word it is joined to."""
    cut = F.coalesce(text.endswith("\u2026"), F.lit(False))
    bare = F.regexp_replace(F.regexp_replace(text, _ANY + "\\S*\u2026$", ""), _ANY + r"\s+$", "")
    return F.struct(F.when(cut, bare).otherwise(text).alias("text"), cut.alias("cut"))


def has_phrase(text: Column, phrases: tuple[str, ...] = S.EXCLUDED_PHRASES) -> Column:
    """Whether a phrase occurs after lowering and apostrophe folding."""
    low = fold_apostrophe(F.lower(text))
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(low, F.lit(p))
    return F.coalesce(found, F.lit(False))


def year_or_unknown(created: Column) -> Column:
    """The first four characters where they are digits, else ``?``."""
    head = F.substring(F.coalesce(created, F.lit("")), 1, 4)
    return F.when(head.rlike(r"(?U)^\d{4}$"), head).otherwise("?")


def reformat_tweet_time(created: Column) -> Column:
    """``Wed Oct 10 20:19:24 +0000 2018`` to ``2018-10-10 20:19:24``; the offset is dropped,
    not applied."""
    p = F.split(created, " ")
    month = F.lpad(_month(p[1]).cast("string"), 2, "0")
    return F.concat_ws(" ", F.concat_ws("-", p[5], month, F.lpad(p[2], 2, "0")), p[3])


def _month(name: Column) -> Column:
    names = F.array(*(F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()))
    return F.array_position(names, name)
