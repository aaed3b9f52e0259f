"""Quality rules, judged per document and per host; DataFrame functions only.

Counts of a text give each rule's verdict on the document. Failures are then summed by
host. A host's rate under a rule is shrunk towards all hosts' by a beta prior whose mean
and strength are estimated from the hosts themselves, so that a host with few documents
is not condemned by one of them. Host verdicts go back to the documents: those of a
rejected host go, and of a suspect host those that fail any rule themselves.

Definitions. Words are runs of characters other than space and U+0009 to U+000D. A null
text has none. A null host is a host of its own. Repeated rows count and are judged each
for itself. Clashing column names: columns that the result adds replace those of the input.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dealt, table, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE = r"[\x20\x09-\x0D]"
_SYMBOL = r"[#*$%&|<>]"
WINDOW = 8


class Thresholds(NamedTuple):
    """A document fails below ``min_words``, above ``max_repeat_percent`` of repeated words
    (both alone decide) or above the percentages of symbols to words and of repeated lines
    to lines (these count for the host). A host is rejected if a rule's shrunk rate is over
    ``reject_rate``; it is suspect if one lies over all hosts' rate by more than ``suspect_sds``
    standard deviations of the prior. The prior weighs as many documents as it is estimated
    to, ``most_strength`` at most, so that large hosts speak for themselves. A rate equal to a
    limit is not over it."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbol_percent: int = 60
    max_dup_line_percent: int = 60
    reject_rate: float = 0.6
    suspect_sds: float = 0.5
    most_strength: float = 100.0


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words that lie in a window of 8 words found twice or more, the first included."""
    keys = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(positions: Column) -> Column:
        # A window adds its 8 words less those that the next one adds itself.
        steps = F.transform(
            positions, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(positions, j + 1) - p, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def from_sorted(found: Column) -> Column:
        twice = F.filter(
            found,
            lambda x, j: (x["k"] == F.get(found, j - 1)["k"]) | (x["k"] == F.get(found, j + 1)["k"]),
        )
        return _let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def from_keys(k: Column) -> Column:
        pairs = F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i")))
        return F.when(F.size(F.array_distinct(k)) < F.size(k), _let(F.sort_array(pairs), from_sorted)).otherwise(F.lit(0))

    return F.when(F.size(words) > WINDOW, _let(keys, from_keys)).otherwise(F.lit(0))


def counts(text: Column) -> Column:
    """A struct of COUNTS and n_lines, of one text; a null text counts as empty."""
    full = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(full, f"{_SPACE}+"), "")
    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    of_words = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = _let(
        lines,
        lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    symbols = (F.char_length(full) - F.char_length(F.regexp_replace(full, _SYMBOL, ""))).cast("long")
    return F.struct(of_words.alias("w"), of_lines.alias("l"), symbols.alias("n_symbols"))


RULES = ("short", "repeats", "symbols", "dup_lines")


def judge_documents(docs: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """``docs`` with COUNTS, one boolean per rule (failed_*) and base_failed."""
    added = {*COUNTS, "n_lines", "base_failed", *(f"failed_{r}" for r in RULES)}
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    counted = docs.withColumn("_c", counts(F.col("text"))).select(
        *kept, "_c.w.n_words", "_c.w.word_chars", "_c.n_symbols", "_c.l.n_dup_lines", "_c.w.n_repeat_words", "_c.l.n_lines"
    )
    failed = {
        "short": F.col("n_words") < limits.min_words,
        "repeats": 100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > limits.max_symbol_percent * F.col("n_words"),
        "dup_lines": 100 * F.col("n_dup_lines") > limits.max_dup_line_percent * F.col("n_lines"),
    }
    out = counted.withColumns({f"failed_{k}": v for k, v in failed.items()})
    return out.withColumn("base_failed", F.col("failed_short") | F.col("failed_repeats"))


def host_rates(judged: DataFrame, host: str, limits: Thresholds = Thresholds()) -> DataFrame:
    """_host, rule, n, f (documents that failed), rate (shrunk), excess (what it is over all
    hosts' rate, in standard deviations of the prior; 0 where that has none).

    Counts are combined before the shuffle, so a hot host arrives as one row per task. The
    prior is estimated per rule by moments: with m the overall rate, the hosts' variance
    beyond that of sampling gives the strength s; rate = (f + m s) / (n + s).
    """
    by_host = judged.groupBy(_host(host).alias("_host")).agg(
        F.count("*").alias("n"), *(F.sum(F.col(f"failed_{r}").cast("long")).alias(r) for r in RULES)
    )
    long = by_host.select("_host", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("f")) for r in RULES))).alias("x")).select("_host", "n", "x.*")
    n, f = F.col("n").cast("double"), F.col("f").cast("double")
    sums = long.groupBy("rule").agg(
        F.count("*").alias("hosts"), F.sum(n).alias("n1"), F.sum(n * n).alias("n2"), F.sum(f).alias("f1"), F.sum(f * f / n).alias("ff")
    )
    m = F.col("f1") / F.col("n1")
    within = m * (1 - m)
    spread = (F.col("ff") - F.col("f1") * m - (F.col("hosts") - 1) * within) / F.nullif(F.col("n1") - F.col("n2") / F.col("n1"), F.lit(0.0))
    prior = sums.select(
        F.col("rule"), m.alias("m"),
        F.least(F.lit(limits.most_strength), F.greatest(F.lit(1.0), F.when(spread > 0, within / spread - 1).otherwise(limits.most_strength))).alias("s"),
    )
    # One row per rule, whatever the input: the only thing broadcast here.
    rate = (f + F.col("m") * F.col("s")) / (n + F.col("s"))
    sd = F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("s") + 1))
    return long.join(F.broadcast(prior), "rule").select("_host", "rule", "n", "f", rate.alias("rate"), F.coalesce((rate - F.col("m")) / F.nullif(sd, F.lit(0.0)), F.lit(0.0)).alias("excess"))


def _host(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("\u0000null"))


#: Rows of one host meet its verdict in so many places.
SALTS = 32


def with_verdicts(judged: DataFrame, host: str, limits: Thresholds = Thresholds()) -> DataFrame:
    """``judged`` with kept.

    Only hosts that are not plainly accepted travel to the join, each once per salt, so the
    rows of a hot host meet it in ``SALTS`` tasks.
    """
    worst = host_rates(judged, host, limits).groupBy("_host").agg(F.max("rate").alias("_worst"), F.max("excess").alias("_excess"))
    marked = worst.where((F.col("_worst") > limits.reject_rate) | (F.col("_excess") > limits.suspect_sds)).select(
        "_host", "_worst", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    )
    # Written, its size is known before the join: a small one is broadcast and no text moves.
    marked = written(marked, "marked-hosts")
    salted = judged.withColumn("_host", _host(host)).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    any_failed = F.col("failed_short") | F.col("failed_repeats") | F.col("failed_symbols") | F.col("failed_dup_lines")
    out = salted.join(marked, ["_host", "_salt"], "left")
    bad = (F.col("_worst") > limits.reject_rate) | (F.col("_worst").isNotNull() & any_failed)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(bad, F.lit(False))).drop("_host", "_salt", "_worst")


def quality_verdicts(docs: DataFrame, host: str = "source", limits: Thresholds = Thresholds()) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept; the texts are read once, and only counts are kept
    for the second pass over them.

    A null text has no words, a null host is one of its own, repeated rows are judged each for
    itself, and an empty table gives no rows. A text is counted whole whatever its length.
    Columns besides these three are not read, so their names can't clash.
    """
    judged = judge_documents(docs.select("doc_id", F.col(f"`{host}`").alias("_source"), "text"), limits).drop("text", "n_lines")
    return with_verdicts(written(judged, "quality"), "_source", limits).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, host: str = "source", limits: Thresholds = Thresholds(), every_rule: bool = False) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns. Texts are written once beside
    their verdicts, so that neither counting nor a shuffle of texts happens twice. With
    ``every_rule`` a document that fails any rule goes, whatever its host; otherwise failures
    of symbols and repeated lines take effect by the host's rate alone, as in op4."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    judged = judge_documents(docs.select(row, "doc_id", "text", F.col(f"`{host}`").alias("_source")), limits)
    marked = with_verdicts(written(judged.drop("text", "n_lines"), "quality"), "_source", limits)
    if every_rule:
        marked = marked.where("not failed_symbols and not failed_dup_lines")
    return marked.where("kept").select("_row.*")


def op4_quality_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(dealt(table(spark, sf_dir, "documents")))


OP4_SQL = r"""
WITH split AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, i, w[i:i+7] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
counted AS (SELECT s.doc_id, coalesce(source, chr(1)) AS host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM split s LEFT JOIN repeated r ON s.doc_id = r.doc_id),
judged AS (SELECT *, n_words < 20 AS f1, 100 * n_repeat_words > 30 * n_words AS f2, 100 * n_symbols > 60 * n_words AS f3, 100 * n_dup_lines > 60 * n_lines AS f4 FROM counted),
long AS (SELECT host, rule, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN CASE rule WHEN 1 THEN f1 WHEN 2 THEN f2 WHEN 3 THEN f3 ELSE f4 END THEN 1 ELSE 0 END) AS DOUBLE) AS f FROM judged, (VALUES (1), (2), (3), (4)) r(rule) GROUP BY host, rule),
sums AS (SELECT rule, count(*) AS hosts, sum(n) AS n1, sum(n * n) AS n2, sum(f) AS f1, sum(f * f / n) AS ff, sum(f) / sum(n) AS m FROM long GROUP BY rule),
spread AS (SELECT rule, m, m * (1 - m) AS within, (ff - f1 * m - (hosts - 1) * m * (1 - m)) / nullif(n1 - n2 / n1, 0) AS v FROM sums),
prior AS (SELECT rule, m, least(100.0, greatest(1.0, CASE WHEN v > 0 THEN within / v - 1 ELSE 100.0 END))::DOUBLE AS s FROM spread),
worst AS (SELECT host, max((f + m * s) / (n + s)) AS rate, max(coalesce(((f + m * s) / (n + s) - m) / nullif(sqrt(m * (1 - m) / (s + 1)), 0), 0)) AS excess FROM long JOIN prior USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
    NOT (f1 OR f2) AND NOT (rate > 0.6 OR (excess > 0.5 AND (f1 OR f2 OR f3 OR f4))) AS kept
FROM judged JOIN worst USING (host)
"""
