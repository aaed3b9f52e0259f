"""Tokens to counts: documents, accounts, rhythm, buckets, and mining of function words.

Counts stay long, (uid, block, key, n): a new key is a new row, never a new column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.functions.text import fold_apostrophe, sentences

TOKEN = r"[\p{L}\p{N}]+(?:['’]\p{L}+)*|[^\p{L}\p{N}\s]"
WORD = r"[\p{L}\p{N}]+(?:['’]\p{L}+)*"
#: A stand-in for a trained tagger, by form alone. It makes no claim to a tagger's accuracy.
LEXICON = {
    "DET": "the a an this that these those every each no".split(),
    "PRON": "i you he she it we they me him her us them my your his its our their who what".split(),
    "ADP": "of in to for on with at by from about as into over after".split(),
    "AUX": "is are was were be been am do does did has have had will would can could should may might must".split(),
    "CCONJ": "and or but nor".split(),
    "SCONJ": "if because while although though since that's unless".split(),
    "PART": "not to's n't".split(),
}
_ENDINGS = (("ing", "VerbForm=Ger"), ("ed", "Tense=Past|VerbForm=Fin"), ("est", "Degree=Sup"), ("er", "Degree=Cmp"), ("s", "Number=Plur"))


def rule_tag(form: Column) -> tuple[Column, Column]:
    """(upos, feats) of a token by the lexicon and word endings."""
    low = fold_apostrophe(F.lower(form))
    upos = F.when(~form.rlike(r"^[\p{L}\p{N}]"), "PUNCT").when(form.rlike(r"^\p{N}"), "NUM")
    for tag, words in LEXICON.items():
        upos = upos.when(low.isin(words), tag)
    upos = upos.when(low.endswith("ly"), "ADV").otherwise("NOUN")
    open_class = F.char_length(low) > 4
    feats = F.lit(None).cast("string")
    for end, value in reversed(_ENDINGS):
        feats = F.when(open_class & low.endswith(end), value).otherwise(feats)
    return upos, feats


def tokenize(docs: DataFrame, tagger=rule_tag) -> DataFrame:
    """docs (uid, doc, text) to one row per token: uid, doc, sent, tok, form, upos, feats.

    ``tagger`` gives upos and feats of a form; a trained one comes in as a table of the same
    columns instead. An empty document has no rows.
    """
    sents = docs.select("uid", "doc", F.posexplode(sentences(F.col("text"))).alias("sent", "s"))
    toks = sents.select("uid", "doc", "sent", F.posexplode(F.regexp_extract_all("s", F.lit(TOKEN), F.lit(0))).alias("tok", "form"))
    upos, feats = tagger(F.col("form"))
    return toks.withColumns({"upos": upos, "feats": feats})


def sentence_lengths(tokens: DataFrame) -> DataFrame:
    """uid, doc, sent, tokens, length: length leaves punctuation out, as everywhere."""
    return tokens.groupBy("uid", "doc", "sent").agg(F.count("*").alias("tokens"), F.count_if(F.col("upos") != "PUNCT").alias("length"))


def sentence_counts(docs: DataFrame) -> DataFrame:
    """``sentence_lengths`` of docs (uid, doc, text) by ``rule_tag``, whose punctuation is any
    token that is no word. Tokens are counted where their text is, so none is shuffled."""
    sents = docs.select("uid", "doc", F.posexplode(sentences(F.col("text"))).alias("sent", "s"))
    n = lambda pattern: F.size(F.regexp_extract_all("s", F.lit(pattern), F.lit(0))).cast("long")
    return sents.select("uid", "doc", "sent", n(TOKEN).alias("tokens"), n(WORD).alias("length")).where("tokens > 0")


def forms(docs: DataFrame, by: Sequence[str] = ("uid",)) -> DataFrame:
    """by, form, times, upos, feats by ``rule_tag``: the tokens of docs (by, text) counted by form
    before anything is told of them, so that a form is tagged once an account."""
    toks = docs.select(*by, F.explode(sentences(F.col("text"))).alias("s")).select(*by, F.explode(F.regexp_extract_all("s", F.lit(TOKEN), F.lit(0))).alias("form"))
    counted = toks.groupBy(*by, "form").agg(F.count("*").alias("times"))
    upos, feats = rule_tag(F.col("form"))
    return counted.withColumns({"upos": upos, "feats": feats})


#: The block in which ``feature_counts`` counts sentences beside features.
SENTENCES = "sentence"


def feature_counts(tokens: DataFrame, words: Sequence[str], by: Sequence[str] = ("uid",), sentence: Sequence[str] = ()) -> DataFrame:
    """by, block, key, n, n_words: function words over all tokens (punctuation too), parts of
    speech, and morphological features; n_words leaves punctuation out. ``sentence`` names the
    columns of a sentence that are counted as well, so that tokens are read once for all. With a
    column ``times`` a row stands for so many tokens."""
    surface = fold_apostrophe(F.lower("form"))
    keyed = tokens.select(
        *by,
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("F").alias("block"), F.when(surface.isin(list(words)), surface).alias("key"))),
                F.array(F.struct(F.lit("M품사").alias("block"), F.col("upos").alias("key"))),
                F.transform(F.split(F.coalesce("feats", F.lit("")), r"\|"), lambda f: F.struct(F.lit("M형태").alias("block"), f.alias("key"))),
                *([F.array(F.struct(F.lit(SENTENCES).alias("block"), F.concat_ws("|", *(F.col(c).cast("string") for c in sentence)).alias("key")))] if sentence else []),
            )
        ).alias("k"),
        (F.col("upos") != "PUNCT").alias("_word"),
        _times(tokens).alias("_times"),
    )
    kept = keyed.select(*by, "k.*", "_word", "_times").where("key is not null and key <> ''")
    return kept.groupBy(*by, "block", "key").agg(F.sum("_times").cast("long").alias("n"), F.sum(F.when(F.col("_word"), F.col("_times")).otherwise(0)).cast("long").alias("n_words"))


def _times(sents: DataFrame) -> Column:
    """How often a row counts: ``times``, where the table has it."""
    return F.col("times") if "times" in sents.columns else F.lit(1)


def account_totals(docs: DataFrame, sents: DataFrame) -> DataFrame:
    """uid and the four totals: documents, sentences, tokens, tokens without punctuation.

    ``sents`` are rows of ``sentence_lengths``: those of documents that are not empty. With a
    column ``times`` a row stands for so many sentences.
    """
    t = _times(sents)
    sums = sents.groupBy("uid").agg(F.sum(t).cast("long").alias("sents"), F.sum(F.col("tokens") * t).alias("toks"), F.sum(F.col("length") * t).alias("words"))
    n = docs.groupBy("uid").agg(F.count("*").alias("docs"))
    return n.join(sums, "uid", "left").select("uid", "docs", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("sents", "toks", "words")))


def rhythm(sents: DataFrame) -> DataFrame:
    """uid, mean_length, punct_share, length_cv per account: the last is the sample deviation
    over the mean, from five sentences on. ``sents`` are rows of ``sentence_lengths``, each
    for ``times`` sentences if it has that column. Sums of whole numbers give the deviation
    without loss."""
    t, length = _times(sents), F.col("length")
    s = sents.groupBy("uid").agg(
        F.sum(t).cast("long").alias("n"), F.sum(F.col("tokens") * t).alias("toks"), F.sum(length * t).alias("words"), F.sum(length * length * t).alias("squares")
    )
    n, words = F.col("n"), F.col("words").cast("decimal(38,0)")
    spread = (n * F.col("squares").cast("decimal(38,0)") - words * words).cast("double")
    cv = F.when((n >= S.MIN_SENTENCES_CV) & (F.col("words") > 0), F.sqrt(F.try_divide(spread, n * (n - 1))) / (F.col("words") / n))
    return s.select("uid", F.try_divide("words", "n").alias("mean_length"), F.try_divide(F.col("toks") - F.col("words"), F.col("toks")).alias("punct_share"), cv.alias("length_cv"))


def merge_accounts(doc_counts: DataFrame) -> DataFrame:
    """Rows of documents (uid, seq, sents, toks, words, lengths array, bucket) to accounts: sums, lengths in
    the order of documents, and a map from bucket to its four totals."""
    buckets = doc_counts.groupBy("uid", "bucket").agg(F.count("*").alias("docs"), F.sum("sents").alias("sents"), F.sum("toks").alias("toks"), F.sum("words").alias("words"))
    of_bucket = buckets.groupBy("uid").agg(
        F.sum("docs").alias("docs"), F.sum("sents").alias("sents"), F.sum("toks").alias("toks"), F.sum("words").alias("words"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", F.array("docs", "sents", "toks", "words"))))).alias("buckets"),
    )
    lengths = doc_counts.groupBy("uid").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "lengths"))), lambda x: x["lengths"])).alias("lengths"))
    return of_bucket.join(lengths, "uid").withColumn("punct", F.col("toks") - F.col("words"))


def bucket_summary(docs: DataFrame, keys: Sequence[str] = ("uid",), year: str = "year", is_reply: str = "is_reply", watched: int = 2023) -> DataFrame:
    """Per account: median and largest year, share of replies, documents in one year."""
    return docs.groupBy(*keys).agg(
        F.median(F.col(year).cast("int")).alias("year_median"), F.max(F.col(year).cast("int")).alias("year_max"),
        F.avg(F.col(is_reply).cast("double")).alias("reply_share"), F.count_if(F.col(year).cast("int") == watched).alias("docs_in_year"),
    )


def mine_function_words(tagged: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """word, total, closed from tagged (word, upos): forms met often enough and mostly in a
    closed class."""
    closed = F.count_if(F.col("upos").isin(*S.CLOSED_CLASSES))
    word = F.trim(F.lower("word"))
    out = tagged.select(word.alias("word"), "upos").where("word <> ''").groupBy("word").agg(F.count("*").alias("total"), closed.alias("closed"))
    return out.where((F.col("total") >= least) & (F.col("closed") / F.col("total") >= share))


def word_list(raw: DataFrame, word: str = "word") -> DataFrame:
    """One row: the words with apostrophes folded, without repeats, sorted, and 16 hex digits
    of their hash."""
    folded = raw.select(fold_apostrophe(F.col(word)).alias("w")).distinct()
    return folded.agg(F.array_sort(F.collect_list("w")).alias("words")).withColumn("checksum", F.substring(F.sha2(F.array_join("words", "\n"), 256), 1, 16))


def axis_map(counts: DataFrame) -> DataFrame:
    """axis, observed values: morphological keys are ``axis=value``; one without a sign is an
    axis whose value is empty."""
    m = counts.where(F.col("block") == "M형태").select(F.split_part("key", F.lit("="), F.lit(1)).alias("axis"), F.when(F.contains("key", F.lit("=")), F.expr("substring(key, instr(key, '=') + 1)")).otherwise("").alias("v"))
    return m.distinct().groupBy("axis").agg(F.sort_array(F.collect_list("v")).alias("values"))


def feature_keys(counts: DataFrame, words: Sequence[str]) -> DataFrame:
    """block, key in order: the function words, then the observed keys, then rhythm."""
    spark = counts.sparkSession
    fixed = spark.createDataFrame([("F", w) for w in words] + [("R", k) for k in S.RHYTHM_KEYS], "block string, key string")
    seen = counts.where(F.col("block").isin("M형태", "M품사")).select("block", "key").distinct()
    return fixed.union(seen)


def truncation_tallies(docs: DataFrame, keys: Sequence[str] = ("label",)) -> DataFrame:
    """Per label: documents, those cut at the end, those that became empty, the share cut.
    ``docs`` has text and cut after the tail was stripped."""
    cut = F.count_if("cut")
    return docs.groupBy(*keys).agg(
        F.count("*").alias("docs"), cut.alias("cut"), F.count_if(F.col("cut") & (F.col("text") == "")).alias("emptied"), (cut / F.count("*")).alias("cut_share")
    )
