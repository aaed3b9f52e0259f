"""Scans, cleaning, selection, counts and features.

Stand-ins: an account is a document's source (or an event's user), a document its row. The
texts hold no urls, mentions or revealing sentences, so some queries put them beside the texts,
and texts to reject as further rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.functions.text import clean_document, collapse, fold_apostrophe, strip_truncated_tail
from quillmark.functions.text import MENTION, URL
from quillmark.operators import audit, counts, features, selection
from quillmark.plans import feature_tables
from quillmark.sources import readers
from quillmark.sources.staging import staged, staging_place, widened

WORDS = ("the", "of", "and", "in", "to", "that", "is", "la", "de", "der", "les")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark, sf) -> DataFrame:
    return widened(table(spark, sf, "documents")).select(F.col("source").alias("uid"), F.col("doc_id").alias("doc"), F.col("doc_id").alias("seq"), "text", "lang")


def with_cases(docs: DataFrame) -> DataFrame:
    """n, text: every document's whole text, some with a revealing sentence, a url and a mention
    beside it, and further rows (n below 0) that the cleaner rejects."""
    n, text = F.col("doc_id"), F.col("text")
    whole = (
        F.when(n % 7 == 0, F.concat(F.lit("As an AI language model I stop. "), text))
        .when(n % 7 == 1, F.concat(text, F.lit(" see https://a.example/"), n, F.lit(" @user_"), n))
        .when(n % 7 == 5, F.concat(text, F.lit(" OpenAI policy? No.")))
        .otherwise(text)
    )
    further = F.when(n % 7 == 2, F.lit("I'm sorry, but I cannot do it.")).when(n % 7 == 3, F.concat(F.lit("short "), n)).otherwise(F.lit(""))
    rows = F.array(F.struct(n.alias("n"), whole.alias("text")), F.struct((-1 - n).alias("n"), further.alias("text")))
    return docs.select(F.explode(F.when(n % 7 < 5, rows).otherwise(F.slice(rows, 1, 1))).alias("r")).select("r.*")


_WHOLE = """CASE n % 7 WHEN 0 THEN 'As an AI language model I stop. ' || text WHEN 1 THEN text || ' see https://a.example/' || n || ' @user_' || n
  WHEN 5 THEN text || ' OpenAI policy? No.' ELSE text END"""
_FURTHER = "CASE n % 7 WHEN 2 THEN 'I''m sorry, but I cannot do it.' WHEN 3 THEN 'short ' || n ELSE '' END"
_WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_REVEAL = "(?i)" + S.SELF_REVEAL.replace("'", "''")
_CLEANED = rf"""
given AS (SELECT n, {_WHOLE} AS t FROM (SELECT doc_id AS n, text FROM documents) UNION ALL SELECT -1 - n, {_FURTHER} FROM (SELECT doc_id AS n FROM documents WHERE doc_id % 7 < 5)),
hit AS (SELECT n, t, nfc_normalize(t) AS c, regexp_matches(nfc_normalize(t), '{_REVEAL}') AS excised FROM given),
cut AS (SELECT *, CASE WHEN excised THEN array_to_string(list_filter(regexp_split_to_array(regexp_replace(c, '([.!?]){_WS}+', '\1' || chr(10), 'g'), '\n+'),
    lambda s: regexp_matches(s, '[^\s]') AND NOT regexp_matches(s, '{_REVEAL}')), ' ') ELSE c END AS k FROM hit),
bare AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(k, '(https?://\S+|www\.\S+)', ' ', 'g'), '@[\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'), '{_WS}+', ' ', 'g')) AS b FROM cut),
judged AS (SELECT n, b, excised, CASE WHEN t IS NULL OR t = '' THEN '{S.REASON_EMPTY}' WHEN excised AND NOT regexp_matches(k, '[^\s]') THEN '{S.REASON_NOTHING_LEFT}'
    WHEN length(b) < 20 THEN CASE WHEN excised THEN '{S.EXCISED_PREFIX}' ELSE '' END || '{S.REASON_SHORT}' END AS reason FROM bare)
"""


def clean_documents(spark, sf):
    d = with_cases(widened(table(spark, sf, "documents")))
    c = d.select(F.col("n").alias("doc_id"), clean_document(F.col("text")).alias("c"))
    return c.select("doc_id", F.md5("c.text").alias("text_md5"), "c.reason", "c.excised")


def reject_reasons(spark, sf):
    return selection.rejections(with_cases(widened(table(spark, sf, "documents"))))


def url_mention_strip(spark, sf):
    p = table(spark, sf, "pages")
    given = F.concat_ws(" ", F.col("url"), F.lit("by @a_b"), F.col("html"))
    bare = collapse(F.regexp_replace(F.regexp_replace(given, URL, " "), MENTION, " "))
    return p.select("page_id", F.md5(bare).alias("bare_md5"), F.char_length(bare).cast("long").alias("n"))


def truncated_tails(spark, sf):
    """Whole texts, two of three with a tail joined to the last word or apart, and further rows
    that are nothing but a tail."""
    d, n = table(spark, sf, "documents"), F.col("doc_id")
    given = F.when(n % 3 == 0, F.concat("text", F.lit("…"))).when(n % 3 == 1, F.concat("text", F.lit(" \n cut…"))).otherwise(F.col("text"))
    rows = F.array(F.struct(given.alias("t")), F.struct(F.lit("cut…").alias("t")))
    d = d.select("lang", F.explode(F.when(n % 3 == 1, rows).otherwise(F.slice(rows, 1, 1))).alias("r"))
    s = d.select("lang", strip_truncated_tail(F.col("r.t")).alias("s")).select(F.col("lang").alias("label"), "s.*")
    return counts.truncation_tallies(s)


_TOKEN = r"[\p{L}\p{N}]+(?:[''’]\p{L}+)*|[^\p{L}\p{N}\s]"
_SENTS = r"""
sents AS (SELECT source AS uid, doc_id AS doc, CAST(sent - 1 AS INT) AS sent, s[sent] AS t FROM (SELECT source, doc_id, s, unnest(range(1, len(s) + 1)) AS sent FROM
    (SELECT source, doc_id, regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') AS s FROM documents))),
"""
_TOKENS = (
    _SENTS
    + rf"""
toks AS (SELECT uid, doc, sent, unnest(regexp_extract_all(t, '{_TOKEN}')) AS form FROM sents),
tok AS (SELECT *, lower(form) AS low, NOT regexp_matches(form, '^[\p{{L}}\p{{N}}]') AS punct FROM toks),
lens AS (SELECT uid, doc, sent, count(*) AS tokens, count(*) FILTER (WHERE NOT punct) AS length FROM tok GROUP BY ALL)
"""
)


def token_counts(spark, sf):
    s = counts.sentence_counts(texts(spark, sf))
    return s.groupBy("doc").agg(F.count("*").alias("sents"), F.sum("tokens").alias("toks"), F.sum("length").alias("words"))


def sentence_lengths(spark, sf):
    return counts.sentence_counts(texts(spark, sf))


def account_totals(spark, sf):
    d = texts(spark, sf)
    return counts.account_totals(d, counts.sentence_counts(d))


def rhythm_features(spark, sf):
    r = counts.rhythm(counts.sentence_counts(texts(spark, sf)))
    return r.select("uid", *(F.round(c, 6).alias(c) for c in ("mean_length", "punct_share", "length_cv")))


def keys_of(spark) -> DataFrame:
    morph = ["Degree=Cmp", "Degree=Sup", "Number=Plur", "Tense=Past", "VerbForm=Fin", "VerbForm=Ger"]
    upos = ["ADP", "ADV", "AUX", "CCONJ", "DET", "NOUN", "NUM", "PART", "PRON", "PUNCT", "SCONJ"]
    axes = {"Degree": ["Cmp", "Sup"], "Number": ["Plur"], "Tense": ["Past"], "VerbForm": ["Fin", "Ger"]}
    return S.key_dimension(spark, {"F": list(WORDS), "M형태": morph, "M품사": upos, "R": list(S.RHYTHM_KEYS)}, axes)


def function_word_rates(spark, sf):
    """The whole feature assembly, of which the function words are returned."""
    _, long = feature_tables.feature_table(texts(spark, sf), WORDS, keys_of(spark))
    return long.where("block = 'F'").select("uid", "key", F.col("value").alias("rate"))


def feature_assembly(spark, sf):
    """Blocks M and R of the assembly: axis totals, ratios, rhythm."""
    _, long = feature_tables.feature_table(texts(spark, sf), WORDS, keys_of(spark))
    return long.where("block <> 'F'").select("uid", "block", "key", F.round("value", 6).alias("value"))


_LEX = " ".join(f"WHEN low IN ({', '.join(chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in ws)}) THEN '{t}'" for t, ws in counts.LEXICON.items())
_TAGGED = rf"""
tagged AS (SELECT *, CASE WHEN punct THEN 'PUNCT' WHEN regexp_matches(form, '^\p{{N}}') THEN 'NUM' {_LEX} WHEN ends_with(low, 'ly') THEN 'ADV' ELSE 'NOUN' END AS upos,
    CASE WHEN length(low) <= 4 THEN NULL WHEN ends_with(low, 'ing') THEN 'VerbForm=Ger' WHEN ends_with(low, 'ed') THEN 'Tense=Past|VerbForm=Fin' WHEN ends_with(low, 'est') THEN 'Degree=Sup'
    WHEN ends_with(low, 'er') THEN 'Degree=Cmp' WHEN ends_with(low, 's') THEN 'Number=Plur' END AS feats FROM tok)
"""
_ACCOUNTS = "accounts AS (SELECT DISTINCT source AS uid FROM documents), total AS (SELECT uid, count(*) FILTER (WHERE NOT punct) AS words, count(*) AS toks FROM tok GROUP BY uid)"
_ASSEMBLY = f"""
WITH {_TOKENS.strip()}, {_TAGGED.strip()}, {_ACCOUNTS},
feat AS (SELECT uid, f AS key, count(*) AS n FROM (SELECT uid, unnest(string_split(feats, '|')) AS f FROM tagged WHERE feats IS NOT NULL) GROUP BY ALL),
axis AS (SELECT uid, split_part(key, '=', 1) AS axis, sum(n) AS a FROM feat GROUP BY ALL),
morph(key, card) AS (VALUES ('Degree=Cmp', 2), ('Degree=Sup', 2), ('Number=Plur', 1), ('Tense=Past', 1), ('VerbForm=Fin', 2), ('VerbForm=Ger', 2)),
pos(key) AS (VALUES ('ADP'), ('ADV'), ('AUX'), ('CCONJ'), ('DET'), ('NOUN'), ('NUM'), ('PART'), ('PRON'), ('PUNCT'), ('SCONJ')),
m AS (SELECT x.uid, 'M형태' AS block, m.key, CASE WHEN card >= 2 THEN coalesce(f.n, 0)::DOUBLE / nullif(coalesce(a.a, 0), 0) ELSE coalesce(f.n, 0)::DOUBLE / nullif(words, 0) END AS value
    FROM accounts x CROSS JOIN morph m LEFT JOIN total t ON t.uid = x.uid LEFT JOIN feat f ON f.uid = x.uid AND f.key = m.key LEFT JOIN axis a ON a.uid = x.uid AND a.axis = split_part(m.key, '=', 1)),
up AS (SELECT uid, upos AS key, count(*) AS n FROM tagged GROUP BY ALL),
p AS (SELECT x.uid, 'M품사' AS block, pos.key, coalesce(up.n, 0)::DOUBLE / nullif(words, 0) AS value FROM accounts x CROSS JOIN pos LEFT JOIN total t ON t.uid = x.uid LEFT JOIN up ON up.uid = x.uid AND up.key = pos.key),
rh AS (SELECT uid, sum(length)::DOUBLE / count(*) AS r1, (sum(tokens) - sum(length))::DOUBLE / sum(tokens) AS r2,
    CASE WHEN count(*) >= 5 AND avg(length) > 0 THEN stddev_samp(length) / avg(length) END AS r3 FROM lens GROUP BY uid),
r AS (SELECT uid, 'R' AS block, unnest(['문장당_토큰수', '구두점_비율', '문장길이_변동계수']) AS key, unnest([r1, r2, r3]) AS value FROM rh)
SELECT uid, block, key, round(value, 6) AS value FROM (SELECT * FROM m UNION ALL SELECT * FROM p UNION ALL SELECT * FROM r)
"""
_WORD_ROWS = ", ".join(f"('{w}')" for w in WORDS)


def function_word_mining(spark, sf):
    t = counts.tokenize(texts(spark, sf)).select(F.col("form").alias("word"), "upos")
    return counts.mine_function_words(t)


def word_list(spark, sf):
    """The words with repeats: every determiner that is there, twice."""
    w = counts.forms(texts(spark, sf), ()).where("upos = 'DET'").select(F.lower("form").alias("word"))
    w = staged(w, "determiners")
    return counts.word_list(w.union(w)).select(F.array_join("words", " ").alias("words"), "checksum")


def feature_keys(spark, sf):
    c = counts.feature_counts(counts.forms(texts(spark, sf)), WORDS)
    return counts.feature_keys(c, WORDS)


def axis_values(spark, sf):
    c = counts.feature_counts(counts.forms(texts(spark, sf)), WORDS)
    return counts.axis_map(c).select("axis", F.array_join("values", ",").alias("values"))


def axis_ratios(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("axis"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("v"))
    c = e.groupBy("user_id", "axis", "v").agg(F.count("*").alias("n"))
    r = features.axis_ratios(c, ["user_id"], "axis", "n", F.col("axis") != "view", F.lit(1000))
    return r.select("user_id", "axis", "v", "n", F.round("ratio", 9).alias("ratio"))


def merge_accounts(spark, sf):
    s = counts.sentence_counts(texts(spark, sf))
    d = s.groupBy("uid", "doc").agg(F.count("*").alias("sents"), F.sum("tokens").alias("toks"), F.sum("length").alias("words"), F.transform(F.array_sort(F.collect_list(F.struct("sent", "length"))), lambda x: x["length"]).alias("lengths"))
    d = d.withColumns({"seq": F.col("doc"), "bucket": (F.col("doc") % 3).cast("string")})
    m = counts.merge_accounts(d)
    b = F.col("buckets")
    return m.select("uid", "docs", "sents", "toks", "words", "punct", F.md5(F.array_join("lengths", ",")).alias("lengths_md5"), *(F.get(F.try_element_at(b, F.lit(str(i))), F.lit(2)).alias(f"toks_{i}") for i in range(3)))


def latest_k_per_user(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 20).alias("uid"), F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH").alias("ts"))
    return selection.latest_posts(e).select("uid", "seq")


def latest_unknown_year(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 20).alias("uid"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.date_format("ts", "yyyy-MM-dd HH")).alias("ts"))
    return selection.latest_tweets(e).select("uid", "seq")


def eligible_accounts(spark, sf):
    d = table(spark, sf, "documents").select(F.concat_ws("-", "source", "lang").alias("uid"), F.col("doc_id").alias("seq"), "text", "lang")
    english = d.where(F.col("lang") == S.TARGET_LANGUAGE)
    return selection.eligible(english, None).groupBy("uid").agg(F.count("*").alias("docs"))


def tagged_subset(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("uid"), F.col("doc_id").alias("seq"), "text", F.col("lang").alias("tag"))
    return selection.tagged_subset(d, "de", 5).select("uid", "seq")


def user_upsert(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("uid"), F.col("event_id").alias("seq"), F.col("event_type").alias("label"), F.col("props").alias("dataset"), F.lit(1).cast("long").alias("n"))
    return selection.upsert_users(e)


def bucket_summary(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("uid"), (F.year("ts") - F.dayofmonth("ts") % 3).alias("year"), (F.col("event_type") == "click").alias("is_reply"))
    s = counts.bucket_summary(e)
    return s.select("uid", "year_median", "year_max", F.round("reply_share", 9).alias("reply_share"), "docs_in_year")


def semi_split(spark, sf):
    l = table(spark, sf, "labels").select(F.col("doc_id").alias("uid"))
    return selection.restrict(table(spark, sf, "documents").withColumnRenamed("doc_id", "uid"), l).select("uid", "lang")


def anti_excluded(spark, sf):
    l = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("uid"))
    return selection.exclude(table(spark, sf, "documents").withColumnRenamed("doc_id", "uid"), l).select("uid", "lang")


def labelled_documents(spark, sf):
    l = table(spark, sf, "labels").select(F.col("doc_id").alias("uid"), F.when(F.col("quality") == 1, "human").otherwise("bot").alias("label"))
    return selection.with_labels(table(spark, sf, "documents").select(F.col("doc_id").alias("uid")), l)


def aligned_rows(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), "lang")
    n = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), F.char_length("text").cast("long").alias("n"))
    return selection.align(d, n)


def disjoint_split(spark, sf):
    l = table(spark, sf, "labels")
    return selection.disjoint_cover([l.where("quality = 1").select("doc_id"), l.where("quality = 0").select("doc_id")], l.select("doc_id"))


def phrase_flagged(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("uid"), F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" I’m SORRY"))).otherwise(F.col("text")).alias("text"))
    return selection.flagged_accounts(d, ("i'm sorry", "trash disgusting", "scum"))


def parsed_once(spark, sf):
    """Tokens of every document although equal texts are tokenized once."""
    t = feature_tables.parse_once(texts(spark, sf))
    return t.groupBy("doc").agg(F.count("*").alias("toks"))


def content_fingerprint(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.substring(F.sha2(fold_apostrophe(F.col("text")), 256), 1, 16).alias("short"))


def nested_scan(spark, sf):
    """Conversations written as objects of many accounts, in the nested form of the post corpus,
    and scanned back. Each object begins with an account that has nothing."""
    c = table(spark, sf, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    user, other = F.filter(turns, lambda x: x["role"] == "user"), F.filter(turns, lambda x: x["role"] == "assistant")
    item = lambda body: lambda x: F.struct(x["text"].alias(body), x["turn"].cast("string").alias("created_utc"), x["role"].alias("subreddit"))
    per = c.groupBy("conv_id").agg(F.transform(user, item("posts")).alias("posts"), F.transform(other, item("comment_body")).alias("comment_1"), F.lit(None).cast("array<struct<comment_body:string>>").alias("comment_2"))
    one = F.concat(F.lit(',"'), F.col("conv_id").cast("string"), F.lit('": '), F.to_json(F.struct("posts", "comment_1", "comment_2")))
    bucket = F.pmod(F.xxhash64("conv_id"), F.lit(32)).alias("bucket")
    lines = per.select(bucket, F.lit(1).alias("at"), one.alias("value"))
    ends = spark.range(32).select("id", F.inline(F.expr("""array(named_struct('at', 0, 'value', '{"": {}'), named_struct('at', 2, 'value', '}'))""")))
    place = staging_place(spark, "nested")
    lines.union(ends).repartition("bucket").sortWithinPartitions("bucket", "at").select("value").write.text(place)
    return readers.read_nested_posts(spark, place).select("uid", "tag_list", F.col("ts").alias("turn"), F.md5("text").alias("text_md5"))


def tweet_scan(spark, sf):
    """Events put into tweets as NDJSON and normalised."""
    e = table(spark, sf, "events")
    key = F.col("event_type")
    tweet = F.struct(
        F.col("event_id").alias("id"), F.date_format("ts", "'Wed' MMM dd HH:mm:ss '+0900' yyyy").alias("created_at"), F.when(key == "view", F.col("props")).alias("full_text"), F.concat(F.when(key == "click", "RT @x ").otherwise(""), F.col("props")).alias("text"),
        F.when(key == "error", F.struct(F.lit(1).alias("id"))).alias("retweeted_status"), F.when(key == "signup", F.col("event_id")).alias("in_reply_to_status_id"), (F.col("value") > 100).alias("is_quote_status"),
        F.col("user_id").alias("retweet_count"), F.struct(F.array_repeat(F.struct(F.lit("h").alias("text")), F.hour("ts") % 3).alias("hashtags")).alias("entities"),
    )
    per = e.groupBy("user_id").agg(F.collect_list(tweet).alias("t"))
    lines = per.select(F.to_json(F.struct(F.col("user_id").cast("string").alias("user_id"), F.lit("bot").alias("label"), F.lit("d").alias("dataset"), F.col("t").alias("user_tweets"))).alias("value"), F.lit(0).cast("long").alias("line"))
    return readers.normalised_tweets(readers.tweet_accounts(lines)).drop("line", "pos", "source", "label")


def table_differences(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.char_length("text").cast("long").alias("n"))
    e = d.where("doc_id % 10 <> 0").withColumns({"n": F.col("n") + (F.col("doc_id") % 4 == 0).cast("long"), "lang": F.when(F.col("doc_id") % 6 == 0, F.lit(None)).otherwise(F.col("lang"))})
    return audit.table_diff(d, e, ["doc_id"])


def tree_differences(spark, sf):
    """Leaves of two versions of an aggregate, compared with a tolerance."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.sum("value").alias("v"), F.max("event_type").alias("t"))
    leaf = lambda n: e.select(F.explode(F.array(F.struct(F.concat(F.lit("/u/"), "user_id", F.lit("/v")).alias("path"), F.lit("number").alias("kind"), F.lit(None).cast("string").alias("text"), n.alias("number")), F.struct(F.concat(F.lit("/u/"), "user_id", F.lit("/t")).alias("path"), F.lit("text").alias("kind"), F.col("t").alias("text"), F.lit(None).cast("double").alias("number")))).alias("x")).select("x.*")
    expected = leaf(F.col("v"))
    actual = leaf(F.col("v") * F.when(F.col("user_id") % 3 == 0, 1 + 1e-6).otherwise(1 + 1e-12)).where("path <> '/u/5/t'")
    return audit.tree_diff(actual, expected, 1e-9)


def wide_table(spark, sf):
    """Long to wide and back to long."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("uid"), F.col("event_type").alias("key")).agg(F.count("*").cast("double").alias("value")).withColumn("block", F.lit("E"))
    wide = features.to_wide(e, [("E", k) for k in ("click", "error", "purchase", "signup", "view")])
    return features.to_long(wide)


_EV = "(SELECT user_id, event_id, event_type, props, value, ts FROM events)"
QUERIES = {
    "clean_documents": (clean_documents, f"WITH {_CLEANED.strip()} SELECT n AS doc_id, CASE WHEN reason IS NULL THEN md5(b) END AS text_md5, reason, coalesce(excised, false) AS excised FROM judged"),
    "reject_reasons": (reject_reasons, f"WITH {_CLEANED.strip()} SELECT reason, coalesce(excised, false) AS excised, count(*) AS documents FROM judged GROUP BY ALL"),
    "url_mention_strip": (url_mention_strip, rf"""WITH b AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(url || ' by @a_b ' || html, '(https?://\S+|www\.\S+)', ' ', 'g'), '@[\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'), '{_WS}+', ' ', 'g')) AS b FROM pages)
        SELECT page_id, md5(b) AS bare_md5, length(b) AS n FROM b"""),
    "truncated_tails": (truncated_tails, rf"""WITH g AS (SELECT lang AS label, doc_id % 3 <> 2 AS cut, CASE doc_id % 3 WHEN 0 THEN text || '…' WHEN 1 THEN text || ' ' || chr(10) || ' cut…' ELSE text END AS t FROM documents
        UNION ALL SELECT lang, true, 'cut…' FROM documents WHERE doc_id % 3 = 1), k AS (SELECT label, cut, CASE WHEN cut THEN regexp_replace(regexp_replace(t, '[^\s\x0B\x{{A0}}]*…$', ''), '{_WS}+$', '') ELSE t END AS t FROM g)
        SELECT label, count(*) AS docs, count(*) FILTER (WHERE cut) AS cut, count(*) FILTER (WHERE cut AND t = '') AS emptied, count(*) FILTER (WHERE cut) / count(*) AS cut_share FROM k GROUP BY label"""),
    "token_counts": (token_counts, f"WITH {_TOKENS.strip()} SELECT doc, count(*) AS sents, CAST(sum(tokens) AS BIGINT) AS toks, CAST(sum(length) AS BIGINT) AS words FROM lens GROUP BY doc"),
    "sentence_lengths": (sentence_lengths, f"WITH {_TOKENS.strip()} SELECT * FROM lens"),
    "account_totals": (account_totals, f"WITH {_TOKENS.strip()} SELECT d.uid, d.docs, s.sents, s.toks, s.words FROM (SELECT source AS uid, count(*) AS docs FROM documents GROUP BY source) d JOIN (SELECT uid, count(*) AS sents, CAST(sum(tokens) AS BIGINT) AS toks, CAST(sum(length) AS BIGINT) AS words FROM lens GROUP BY uid) s ON s.uid = d.uid"),
    "rhythm_features": (rhythm_features, f"""WITH {_TOKENS.strip()} SELECT uid, round(sum(length)::DOUBLE / count(*), 6) AS mean_length, round((sum(tokens) - sum(length))::DOUBLE / sum(tokens), 6) AS punct_share,
        round(CASE WHEN count(*) >= 5 AND avg(length) > 0 THEN stddev_samp(length) / avg(length) END, 6) AS length_cv FROM lens GROUP BY uid"""),
    "function_word_rates": (function_word_rates, f"""WITH {_TOKENS.strip()}, {_ACCOUNTS}, w(key) AS (VALUES {_WORD_ROWS}), c AS (SELECT uid, replace(low, '’', '''') AS key, count(*) AS n FROM tok GROUP BY ALL)
        SELECT a.uid, w.key, round(coalesce(c.n, 0)::DOUBLE / nullif(t.words, 0), 6) AS rate FROM accounts a CROSS JOIN w LEFT JOIN total t ON t.uid = a.uid LEFT JOIN c ON c.uid = a.uid AND c.key = w.key"""),
    "feature_assembly": (feature_assembly, _ASSEMBLY),
    "function_word_mining": (function_word_mining, f"""WITH {_TOKENS.strip()}, {_TAGGED.strip()} SELECT low AS word, count(*) AS total, count(*) FILTER (WHERE upos IN ('ADP','AUX','CCONJ','SCONJ','DET','PRON','PART')) AS closed
        FROM tagged GROUP BY low HAVING count(*) >= 5 AND count(*) FILTER (WHERE upos IN ('ADP','AUX','CCONJ','SCONJ','DET','PRON','PART')) / count(*) >= 0.5"""),
    "word_list": (word_list, f"""WITH {_TOKENS.strip()}, {_TAGGED.strip()}, w AS (SELECT DISTINCT replace(low, '’', '''') AS w FROM tagged WHERE upos = 'DET')
        SELECT string_agg(w, ' ' ORDER BY w) AS words, substr(sha256(string_agg(w, chr(10) ORDER BY w)), 1, 16) AS checksum FROM w"""),
    "feature_keys": (feature_keys, f"""WITH {_TOKENS.strip()}, {_TAGGED.strip()} SELECT 'F' AS block, key FROM (VALUES {_WORD_ROWS}) t(key) UNION ALL SELECT DISTINCT 'M품사', upos FROM tagged
        UNION ALL SELECT DISTINCT 'M형태', unnest(string_split(feats, '|')) FROM tagged WHERE feats IS NOT NULL UNION ALL SELECT 'R', unnest(['문장당_토큰수', '구두점_비율', '문장길이_변동계수'])"""),
    "axis_values": (axis_values, f"""WITH {_TOKENS.strip()}, {_TAGGED.strip()}, f AS (SELECT DISTINCT unnest(string_split(feats, '|')) AS f FROM tagged WHERE feats IS NOT NULL)
        SELECT split_part(f, '=', 1) AS axis, string_agg(split_part(f, '=', 2), ',' ORDER BY split_part(f, '=', 2)) AS "values" FROM f GROUP BY 1"""),
    "axis_ratios": (axis_ratios, """WITH c AS (SELECT user_id, event_type AS axis, CAST(json_extract_string(props, '$.k') AS INT) % 4 AS v, count(*) AS n FROM events GROUP BY ALL)
        SELECT user_id, axis, v, n, round(CASE WHEN axis <> 'view' THEN n / sum(n) OVER (PARTITION BY user_id, axis) ELSE n / 1000.0 END::DOUBLE, 9) AS ratio FROM c"""),
    "merge_accounts": (merge_accounts, f"""WITH {_TOKENS.strip()} SELECT uid, count(DISTINCT doc) AS docs, count(*) AS sents, CAST(sum(tokens) AS BIGINT) AS toks, CAST(sum(length) AS BIGINT) AS words, CAST(sum(tokens) - sum(length) AS BIGINT) AS punct,
        md5(string_agg(length::VARCHAR, ',' ORDER BY doc, sent)) AS lengths_md5, CAST(sum(tokens) FILTER (WHERE doc % 3 = 0) AS BIGINT) AS toks_0, CAST(sum(tokens) FILTER (WHERE doc % 3 = 1) AS BIGINT) AS toks_1, CAST(sum(tokens) FILTER (WHERE doc % 3 = 2) AS BIGINT) AS toks_2 FROM lens GROUP BY uid"""),
    "latest_k_per_user": (latest_k_per_user, "SELECT user_id % 20 AS uid, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 20 ORDER BY strftime(ts, '%Y-%m-%d %H') DESC, event_id DESC) <= 200"),
    "latest_unknown_year": (latest_unknown_year, """SELECT user_id % 20 AS uid, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 20
        ORDER BY event_type = 'error' DESC, CASE WHEN event_type = 'error' THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d %H') END DESC, event_id DESC) <= 200"""),
    "eligible_accounts": (eligible_accounts, "SELECT source || '-' || lang AS uid, count(*) AS docs FROM documents WHERE lang = 'en' GROUP BY 1 HAVING count(*) >= 10"),
    "tagged_subset": (tagged_subset, "SELECT source AS uid, doc_id AS seq FROM documents WHERE lang = 'de' QUALIFY count(*) OVER (PARTITION BY source) >= 5"),
    "user_upsert": (user_upsert, "SELECT user_id AS uid, arg_max(event_type, event_id) AS label, arg_max(props, event_id) AS dataset, count(*) AS n FROM events GROUP BY user_id"),
    "bucket_summary": (bucket_summary, """WITH e AS (SELECT user_id AS uid, year(ts) - day(ts) % 3 AS y, event_type = 'click' AS r FROM events)
        SELECT uid, median(y)::DOUBLE AS year_median, max(y)::INT AS year_max, round(avg(r::INT), 9) AS reply_share, count(*) FILTER (WHERE y = 2023) AS docs_in_year FROM e GROUP BY uid"""),
    "semi_split": (semi_split, "SELECT doc_id AS uid, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
    "anti_excluded": (anti_excluded, "SELECT doc_id AS uid, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "labelled_documents": (labelled_documents, f"SELECT d.doc_id AS uid, CASE WHEN l.doc_id IS NULL THEN '{S.UNLABELLED}' WHEN quality = 1 THEN 'human' ELSE 'bot' END AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"),
    "aligned_rows": (aligned_rows, "SELECT doc_id AS uid, lang, length(text) AS n FROM documents"),
    "disjoint_split": (disjoint_split, "SELECT count(*) = count(DISTINCT doc_id) AND bool_and(quality IN (0, 1)) AS holds FROM labels"),
    "phrase_flagged": (phrase_flagged, "SELECT source AS uid, bool_or(doc_id % 5 = 0 OR contains(lower(text), 'trash disgusting') OR contains(lower(text), 'scum') OR contains(replace(lower(text), '’', ''''), 'i''m sorry')) AS flagged FROM documents GROUP BY source"),
    "parsed_once": (parsed_once, f"WITH {_TOKENS.strip()} SELECT doc, count(*) AS toks FROM tok GROUP BY doc"),
    "content_fingerprint": (content_fingerprint, "SELECT doc_id, sha256(text) AS sha256, substr(sha256(replace(text, '’', '''')), 1, 16) AS short FROM documents"),
    "nested_scan": (nested_scan, "SELECT CAST(conv_id AS VARCHAR) AS uid, CASE role WHEN 'user' THEN 0 ELSE 1 END AS tag_list, CAST(turn AS VARCHAR) AS turn, md5(text) AS text_md5 FROM conversations WHERE role IN ('user', 'assistant')"),
    "tweet_scan": (tweet_scan, """SELECT CAST(event_id AS VARCHAR) AS tweet_id, CAST(user_id AS VARCHAR) AS user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at,
        CASE event_type WHEN 'view' THEN props WHEN 'click' THEN 'RT @x ' || props ELSE props END AS text, CAST(event_type IN ('click', 'error') AS INT) AS is_retweet, CAST(value > 100 AS INT) AS is_quote,
        CAST(event_type = 'signup' AS INT) AS is_reply, user_id AS retweet_count, CAST(0 AS BIGINT) AS favorite_count, CAST(hour(ts) % 3 AS INT) AS hashtag_count, 0 AS url_count, 0 AS mention_count FROM events"""),
    "table_differences": (table_differences, """SELECT doc_id, '*' AS "column" FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, 'n' FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 4 = 0
        UNION ALL SELECT doc_id, 'lang' FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 6 = 0"""),
    "tree_differences": (tree_differences, """WITH u AS (SELECT user_id, sum(value) AS v FROM events GROUP BY user_id) SELECT '/u/' || user_id || '/v' AS path, 'number' AS problem FROM u WHERE user_id % 3 = 0 AND v <> 0
        UNION ALL SELECT '/u/5/t', 'missing' FROM u WHERE user_id = 5"""),
    "wide_table": (wide_table, """SELECT uid, 'E' AS block, key, n AS value FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS uid FROM events) u CROSS JOIN (SELECT DISTINCT event_type AS key FROM events) k
        LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS uid2, event_type AS key2, count(*)::DOUBLE AS n FROM events GROUP BY ALL) e ON uid = uid2 AND key = key2"""),
}
