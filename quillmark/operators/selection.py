"""Which documents and accounts take part."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.functions.text import clean_document, has_phrase, year_or_unknown

#: A stand-in for a trained language identifier: frequent words of each language.
FREQUENT = {
    "en": "the and of to in is that it was for".split(),
    "de": "der die und das ist nicht von mit den ein".split(),
    "fr": "le la les et des est que dans pour une".split(),
    "es": "el los y en que las por una con del".split(),
}


def frequent_word_language(text: Column) -> Column:
    """The language whose frequent words the text has most of, English on a tie."""
    words = F.split(F.lower(text), r"[^\p{L}]+")

    def hits_of(frequent: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(frequent)))

    hits = [(name, hits_of(ws)) for name, ws in FREQUENT.items()]
    best = F.greatest(*(n for _, n in hits))
    out = F.lit("en")
    for name, n in reversed(hits):
        out = F.when(n == best, name).otherwise(out)
    return out


def cleaned(docs: DataFrame, composed: bool = False) -> DataFrame:
    """``docs`` whose text is cleaned; rejected documents go."""
    return docs.withColumn("_c", clean_document(F.col("text"), composed)).withColumn("text", F.col("_c.text")).drop("_c").where("text is not null")


def rejections(docs: DataFrame, keys: Sequence[str] = (), composed: bool = False) -> DataFrame:
    """keys, reason, excised, documents."""
    c = docs.select(*keys, clean_document(F.col("text"), composed).alias("c")).select(*keys, "c.reason", "c.excised")
    return c.groupBy(*keys, "reason", "excised").agg(F.count("*").alias("documents"))


def latest(docs: DataFrame, key: str | Sequence[str], order: Sequence[Column], k: int = S.MAX_DOCS) -> DataFrame:
    """The last k rows of each key in the ascending ``order``, which must be total. Each task
    keeps k rows of a key before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*(c.desc() for c in order)))
    return docs.withColumn("_rn", rn).where(F.col("_rn") <= k).drop("_rn")


def latest_posts(docs: DataFrame, k: int = S.MAX_DOCS) -> DataFrame:
    """By time as text; of equal times the later in the list (seq) is newer."""
    return latest(docs, "uid", [F.coalesce("ts", F.lit("")), F.col("seq")], k)


def latest_tweets(tweets: DataFrame, k: int = S.MAX_DOCS) -> DataFrame:
    """By (unknown year, time, sequence): a tweet of unknown year counts as newest."""
    unknown = year_or_unknown(F.col("ts")) == "?"
    return latest(tweets, "uid", [unknown, F.coalesce("ts", F.lit("")), F.col("seq")], k)


def eligible(docs: DataFrame, language: Callable[[Column], Column] | None = frequent_word_language, least: int = S.MIN_DOCS, order: str = "seq") -> DataFrame:
    """``docs`` of accounts with enough documents whose joined text is in the target language.

    An account has at most ``MAX_DOCS`` documents by then, so joining them is bounded.
    ``language=None`` leaves the language test out.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")
    accounts = docs.groupBy("uid").agg(F.count("*").alias("n"), *([joined.alias("joined")] if language else [])).where(F.col("n") >= least)
    if language:
        accounts = accounts.where(language(F.col("joined")) == S.TARGET_LANGUAGE)
    return docs.join(accounts.select("uid"), "uid", "left_semi")


def tagged_subset(docs: DataFrame, tag: str = "politics", least: int = S.MIN_DOCS) -> DataFrame:
    """Documents with a tag, of accounts with enough of them; no second language test."""
    return eligible(docs.where(F.col("tag") == tag), None, least)


def comments_only(docs: DataFrame, accounts: DataFrame, language=frequent_word_language) -> DataFrame:
    """The rules applied anew to comments, for accounts that were eligible before."""
    own = docs.where(F.col("tag_list") != 0).join(accounts.select("uid").distinct(), "uid", "left_semi")
    return eligible(latest_posts(own), language)


def tweets_corpus(tweets: DataFrame, language=frequent_word_language) -> DataFrame:
    """Original tweets (no retweets, no empty account), cleaned, latest 200, eligible; tag is
    ``year|reply``."""
    own = tweets.where("is_retweet = 0 and user_id is not null and user_id <> ''").select(
        F.col("user_id").alias("uid"), "seq", F.col("created_at").alias("ts"), "text",
        F.concat_ws("|", year_or_unknown(F.col("created_at")), F.when(F.col("is_reply") != 0, "1").otherwise("0")).alias("tag"),
    )
    return eligible(latest_tweets(cleaned(own)), language)


def flagged_accounts(docs: DataFrame, phrases: tuple[str, ...] = S.EXCLUDED_PHRASES, key: str = "uid") -> DataFrame:
    """key, flagged: whether any document has one of the phrases."""
    return docs.groupBy(key).agg(F.bool_or(has_phrase(F.col("text"), phrases)).alias("flagged"))


def with_labels(docs: DataFrame, users: DataFrame) -> DataFrame:
    """Label by account; accounts without a row keep an explicit 'no label'."""
    return docs.join(users.select("uid", "label"), "uid", "left").withColumn("label", F.coalesce("label", F.lit(S.UNLABELLED)))


def restrict(df: DataFrame, uids: DataFrame) -> DataFrame:
    return df.join(uids.select("uid").distinct(), "uid", "left_semi")


def exclude(df: DataFrame, uids: DataFrame) -> DataFrame:
    return df.join(uids.select("uid").distinct(), "uid", "left_anti")


def align(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("uid",)) -> DataFrame:
    """Rows of two tables side by side; raises when it runs if a key is on one side only."""
    left, right = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    both = left.join(right, list(keys), "full")
    checked = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("a key is in one table only"))).otherwise(F.lit(True))
    return both.where(checked).drop("_a", "_b")


def upsert_users(rows: DataFrame) -> DataFrame:
    """Account rows (uid, seq, label, dataset, n) to one each: the last label and dataset, n
    summed."""
    return rows.groupBy("uid").agg(F.max_by("label", "seq").alias("label"), F.max_by("dataset", "seq").alias("dataset"), F.sum("n").alias("n"))


def same_elements(a: DataFrame, b: DataFrame) -> DataFrame:
    """One boolean: equal as multisets, by the balance of each row; either is read once."""
    sides = a.withColumn("_side", F.lit(1)).union(b.select(*a.columns).withColumn("_side", F.lit(-1)))
    balance = sides.groupBy(*(F.col(f"`{c}`") for c in a.columns)).agg(F.sum("_side").alias("_side"))
    return balance.agg((F.count_if(F.col("_side") != 0) == 0).alias("equal"))


def disjoint_cover(parts: Sequence[DataFrame], whole: DataFrame) -> DataFrame:
    """One boolean: the parts share no row and together are the whole (all one-column)."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    c = whole.columns[0]
    counted = both.select(F.col(both.columns[0]).alias(c)).groupBy(c).agg(F.count("*").alias("_n"))
    joined = counted.join(whole.distinct().withColumn("_w", F.lit(1)), c, "full")
    return joined.agg(F.bool_and((F.coalesce("_n", F.lit(0)) == 1) & F.col("_w").isNotNull()).alias("holds"))
