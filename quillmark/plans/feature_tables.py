"""Raw corpora to feature tables: select, tokenize, count, assemble."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.functions.text import strip_truncated_tail
from quillmark.operators import counts, features, selection
from quillmark.sources.staging import staged


def post_corpora(documents: DataFrame, language=selection.frequent_word_language) -> dict[str, DataFrame]:
    """``sources.readers.nested_posts`` to the three corpora: all, comments only, politics only."""
    clean = selection.cleaned(documents)
    main = selection.eligible(selection.latest_posts(clean), language)
    return {"posts": main, "comments": selection.comments_only(clean, main.select("uid"), language), "politics": selection.tagged_subset(main)}


def tweet_corpora(tweets: DataFrame, language=selection.frequent_word_language) -> dict[str, DataFrame]:
    """Stored tweets with a sequence to two corpora: as they are, and without cut tails. A
    document that a tail was all of stays, empty."""
    main = selection.tweets_corpus(tweets, language)
    cut = main.withColumn("_s", strip_truncated_tail(F.col("text"))).withColumns({"text": F.col("_s.text"), "cut": F.col("_s.cut")}).drop("_s")
    return {"tweets": main, "tweets_trunc": cut}


#: Documents that a tokenized text is passed on to at once.
PLACES = 1000


def parse_once(docs: DataFrame, tagger=counts.rule_tag) -> DataFrame:
    """Tokens of ``docs`` (uid, seq, text) where equal texts are tokenized once for ``PLACES``
    documents; empty ones not at all. A text carries the documents that have it, so that no
    token is shuffled."""
    own = docs.where("text <> ''").select(F.sha2("text", 256).alias("h"), "text", F.struct("uid", F.col("seq").alias("doc")).alias("at"))
    once = own.groupBy("h").agg(F.first("text").alias("text"), F.collect_list("at").alias("at"))
    some = F.transform(F.sequence(F.lit(1), F.size("at"), F.lit(PLACES)), lambda i: F.slice("at", i, PLACES))
    parsed = counts.tokenize(once.select("text", F.explode(some).alias("uid"), F.lit(0).alias("doc")), tagger)
    return parsed.select(F.explode("uid").alias("at"), *(c for c in parsed.columns if c not in ("uid", "doc"))).select("at.*", "*").drop("at")


def feature_table(
    docs: DataFrame, words: Sequence[str], keys: DataFrame, tagger=counts.rule_tag, parse: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(totals, long features) of a corpus (uid, seq, text).

    ``tagger`` tags a form by itself. A trained parser comes in as ``parse``: from texts (uid,
    doc, text) to token rows (uid, doc, sent, tok, form, upos, feats), by ``mapInPandas`` say.

    With a parser or another tagger equal texts are tokenized once, features and sentences of them
    counted in one pass; what joins the accounts are these counts, with the number of times an
    account has the text. ``rule_tag`` goes by form, so forms are counted by account first.
    """
    if parse is None and tagger is counts.rule_tag:
        named = docs.where("text <> ''").select("uid", F.col("seq").alias("doc"), "text")
        n = staged(counts.feature_counts(counts.forms(named), words), "form-counts")
        lengths = counts.sentence_counts(named).groupBy("uid", "tokens", "length").agg(F.count("*").alias("times"))
        sents = staged(lengths, "sentence-lengths")
        totals = counts.account_totals(docs, sents)
        return totals, features.assemble(totals, n, counts.rhythm(sents), keys)
    own = docs.where("text <> ''").select("uid", F.sha2("text", 256).alias("h"), "text")
    places = own.groupBy("uid", "h").agg(F.count("*").alias("m"))
    # Dealt by hash to a stated number of tasks: texts are small beside the work of tokenizing,
    # so partitions merged by size would leave cores idle.
    n_tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = own.select(F.col("h").alias("uid"), F.lit(0).alias("doc"), "text").repartition(n_tasks, "uid").dropDuplicates(["uid"])
    counted = staged(counts.feature_counts(parse(distinct) if parse else counts.tokenize(distinct, tagger), words, sentence=("sent",)).withColumnRenamed("uid", "h"), "text-counts")
    of_sentence = F.col("block") == counts.SENTENCES
    n = counted.where(~of_sentence).join(places, "h").groupBy("uid", "block", "key").agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    sents = counted.where(of_sentence).join(places, "h").select("uid", F.col("n").alias("tokens"), F.col("n_words").alias("length"), F.col("m").alias("times"))
    totals = counts.account_totals(docs, sents)
    return totals, features.assemble(totals, n, counts.rhythm(sents), keys)


def tweet_info(docs: DataFrame) -> DataFrame:
    """Account columns from the tags ``year|reply`` of the documents."""
    part = F.split("tag", r"\|")
    return counts.bucket_summary(docs.select("uid", part[0].alias("year"), (part[1] == "1").alias("is_reply")))


def truncation_report(cut: DataFrame, labels: DataFrame) -> DataFrame:
    return counts.truncation_tallies(cut.join(labels.select("uid", "label"), "uid"))


def excluded_accounts(docs: DataFrame) -> DataFrame:
    return selection.flagged_accounts(docs).where("flagged").select("uid")


def smoke(docs: DataFrame, n: int = 3) -> DataFrame:
    """The documents of the first accounts by id."""
    return docs.join(docs.select("uid").distinct().orderBy("uid").limit(n), "uid", "left_semi")


INFO_TWEETS = [("라벨", "string"), ("자료원", "string"), *((c, "long") for c in S.COUNT_COLUMNS), ("연도_중앙값", "double"), ("연도_최대", "int"), ("답글비율", "double"), ("문서수_2023", "long")]
INFO_POSTS = [("라벨", "string"), *((c, "long") for c in S.COUNT_COLUMNS)]
