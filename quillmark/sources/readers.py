"""Scans of the corpora and tables, all with stated schemas.

A gzip file is read by one task; ``spread`` deals its rows out before any work on them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark import schema as S
from quillmark.functions.text import reformat_tweet_time
from quillmark.operators.features import to_long

from .nested import json_entries

_POST = "array<struct<{body}:string,created_utc:string,subreddit:string>>"
NESTED_POSTS = f"map<string,struct<posts:{_POST.format(body='posts')},comment_1:{_POST.format(body='comment_body')},comment_2:{_POST.format(body='comment_body')}>>"


def spread(df: DataFrame, n: int | None = None) -> DataFrame:
    return df.repartition(n or df.sparkSession.sparkContext.defaultParallelism)


def read_wide(spark: SparkSession, path: str, info: Sequence[tuple[str, str]]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """A feature table (csv, gzip or not) to its wide form and the keys in order.

    ``info`` gives names and types of the columns between uid and the features; a feature's
    column is ``block|key``, split at the first bar, and an empty cell is null.
    """
    head = spark.read.text(path).limit(1).first()
    names = spark.createDataFrame([(head[0],)], "h string").select(F.from_csv("h", ", ".join(f"_{i} string" for i in range(head[0].count(",") + 1)), {"maxCharsPerColumn": "-1"}).alias("x")).first()[0]
    names = [v for v in names if v is not None]
    at = next(i for i, n in enumerate(names) if "|" in n)
    if names[1:at] != [n for n, _ in info]:
        raise ValueError(f"info columns are {names[1:at]}")
    fields = [T.StructField("uid", T.StringType())]
    fields += [T.StructField(n, T._parse_datatype_string(t)) for n, t in info]
    fields += [T.StructField(n, T.DoubleType()) for n in names[at:]]
    keys = [tuple(n.split("|", 1)) for n in names[at:]]
    return spark.read.schema(T.StructType(fields)).csv(path, header=True, enforceSchema=False), keys


def read_long(spark: SparkSession, path: str, info: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(info table, long features) of a wide csv file."""
    wide, _ = read_wide(spark, path, info)
    return wide.select("uid", *[n for n, _ in info]), to_long(wide)


def infer_column(values: Column) -> Column:
    """The narrowest of long, double, string that a whole column of text fits, as a name."""
    whole = F.bool_and(F.coalesce(values.rlike(r"^\s*[+-]?\d+\s*$"), F.lit(False)))
    number = F.bool_and((values == "") | values.try_cast("double").isNotNull())
    return F.when(whole, "long").when(number, "double").otherwise("string")


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def nested_posts(raw: DataFrame, column: str = "value") -> DataFrame:
    """The nested corpus as JSON texts, in one row or an account a row, to (uid, tag_list, seq, ts,
    text, tag).

    Posts, then the two lists of comments; a null list is empty, a null field an empty text.
    ``seq`` numbers an account's documents in that order.
    """
    # The text is parsed once, to one row an account; accounts are dealt out before their lists
    # are taken apart.
    users = spread(raw.select(F.explode(F.from_json(column, NESTED_POSTS)).alias("uid", "u")))

    def items(i: int, name: str, body: str) -> Column:
        # Lists are far shorter than this, so the number keeps their order.
        own = lambda d, pos: F.struct(F.lit(i).alias("tag_list"), (F.lit(i << 32) + pos).alias("seq"), F.coalesce(d["created_utc"], F.lit("")).alias("ts"), F.coalesce(d[body], F.lit("")).alias("text"), d["subreddit"].alias("tag"))
        listed = F.transform(F.col(f"u.{name}"), own)
        return F.coalesce(listed, F.filter(F.array(own(F.lit(None).cast(_POST.format(body=body)[6:-1]), F.lit(0))), lambda _: F.lit(False)))

    lists = (("posts", "posts"), ("comment_1", "comment_body"), ("comment_2", "comment_body"))
    return users.select("uid", F.inline(F.concat(*(items(i, name, body) for i, (name, body) in enumerate(lists)))))


def read_nested_posts(spark: SparkSession, path: str) -> DataFrame:
    """``nested_posts`` of a file, or of files, that hold one object of accounts each; byte ranges
    are read side by side. A name that comes twice is taken twice."""
    return nested_posts(json_entries(spark, path))


def post_labels(spark: SparkSession, path: str) -> DataFrame:
    """uid, label: a character setting that is not blank makes a bot."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').select("user_id", "character_setting")
    blank = ~F.coalesce(F.col("character_setting"), F.lit("")).rlike(r"(?U)\S")
    return rows.select(F.col("user_id").alias("uid"), F.when(blank, "human").otherwise("bot").alias("label"))


def conllu_words(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """word, upos of every plain token line: no comments, blanks, multiword or empty tokens."""
    part = F.split("value", "\t")
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).where("value <> '' and not startswith(value, '#')").where(F.size(part) >= 4)
    return lines.where(~part[0].rlike(r"[-.]")).select(part[1].alias("word"), part[3].alias("upos"))


_TWEET = (
    "id_str string, id bigint, created_at string, full_text string, text string, is_quote_status boolean, in_reply_to_status_id bigint, "
    "retweet_count bigint, favorite_count bigint, entities struct<hashtags:array<string>,urls:array<string>,user_mentions:array<string>>, source string"
)


def tweet_accounts(lines: DataFrame) -> DataFrame:
    """NDJSON lines (value, line) to uid, seq, label, dataset, n and the tweets as JSON texts."""
    a = F.from_json("value", "user_id string, label string, dataset string, user_tweets array<string>")
    return lines.select(a.alias("a"), "line").select(
        F.col("a.user_id").alias("uid"), F.col("line").alias("seq"), "a.label", "a.dataset", F.size("a.user_tweets").cast("long").alias("n"), F.col("a.user_tweets").alias("tweets")
    )


def normalised_tweets(accounts: DataFrame) -> DataFrame:
    """The tweets of ``tweet_accounts`` in the stored schema, with their order (line, pos).

    Whether a key is present differs from whether it is null: a tweet's full text is taken
    where its key is there, and a key of a retweet marks one. A map keeps that difference.
    """
    one = accounts.select("uid", "label", F.col("seq").alias("line"), F.posexplode("tweets").alias("pos", "j"))
    t = one.select("uid", "label", "line", "pos", F.from_json("j", _TWEET).alias("t"), F.from_json("j", "map<string,string>").alias("m"))
    text = F.when(F.map_contains_key("m", "full_text"), F.col("t.full_text")).when(F.map_contains_key("m", "text"), F.col("t.text")).otherwise("")
    size = lambda c: F.coalesce(F.nullif(F.size(f"t.entities.{c}"), F.lit(-1)), F.lit(0))
    count = lambda c: F.when(F.map_contains_key("m", c), F.col(f"t.{c}")).otherwise(F.lit(0).cast("long"))
    retweet = F.map_contains_key("m", "retweeted_status") | F.coalesce(F.startswith(text, F.lit("RT @")), F.lit(False))
    return t.select(
        F.coalesce(F.nullif("t.id_str", F.lit("")), F.col("t.id").cast("string")).alias("tweet_id"), F.col("uid").alias("user_id"), "label",
        reformat_tweet_time(F.col("t.created_at")).alias("created_at"), text.alias("text"), retweet.cast("int").alias("is_retweet"),
        F.coalesce("t.is_quote_status", F.lit(False)).cast("int").alias("is_quote"), F.col("t.in_reply_to_status_id").isNotNull().cast("int").alias("is_reply"),
        count("retweet_count").alias("retweet_count"), count("favorite_count").alias("favorite_count"),
        size("hashtags").alias("hashtag_count"), size("urls").alias("url_count"), size("user_mentions").alias("mention_count"),
        F.when(F.map_contains_key("m", "source"), F.col("t.source")).otherwise("").alias("source"), "line", "pos",
    )


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    """Accounts of an NDJSON(.gz) file with their order in it."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    return tweet_accounts(spread(lines))


def stored_tweets(spark: SparkSession, place: str) -> DataFrame:
    """Projection and filter reach the scan: original tweets only, four columns."""
    return spark.read.schema(S.TWEETS).parquet(f"{place}/tweets").where("is_retweet = 0").select("user_id", "created_at", "text", "is_reply")


def stored_users(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.schema(S.USERS).parquet(f"{place}/users")


_CALL = "`종류` string, `슬롯id` string, `요청모델` string, `상태` string, `게시물id` string, `게시물시각` string, `댓글` string, `설정해시` string"


def numbered_lines(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """value, f (the file), source_line (from 1, by offset within the file). Splits of a file are
    counted, so that none of its lines have to meet."""
    text = spark.read.text(paths if isinstance(paths, str) else list(paths))
    at = [F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i")]
    splits = text.select(*at).groupBy("f", "start").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("f").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("f", "start", "first", F.coalesce(before, F.lit(0)).alias("before"))
    lines = text.select("value", *at).join(F.broadcast(offsets), ["f", "start"])
    return lines.select("value", "f", (F.col("before") + F.col("i") - F.col("first") + 1).alias("source_line"))


def call_records(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Slot records of call logs with public column names. A line's number is its rank by
    offset within its file."""
    r = numbered_lines(spark, paths).select(F.regexp_extract("f", r"([^/]+)$", 1).alias("source_file"), "source_line", F.from_json("value", _CALL).alias("r")).where("r.`종류` = '슬롯'")
    names = {"slot_id": "슬롯id", "model": "요청모델", "status": "상태", "post_id": "게시물id", "post_time": "게시물시각", "comment": "댓글", "settings_hash": "설정해시"}
    return r.select("source_file", "source_line", *(F.col(f"r.`{v}`").alias(k) for k, v in names.items()))
