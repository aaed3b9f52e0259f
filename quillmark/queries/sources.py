"""Scans, sinks, checks and the parts of the plans that the other modules leave out.

What a scan reads is first written by its sink, to the staging folder, from the sample tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.operators import audit, features, language, resampling, selection, significance
from quillmark.plans import evaluation, feature_tables, report
from quillmark.sources import readers, sinks
from quillmark.sources.staging import staged, staging_place

from .stats import _DOC, _MW, doc_features, rounded
from .text import table

KINDS = ("click", "error", "purchase", "signup", "view")


def wide_csv_scan(spark, sf):
    """A feature table with two info columns, written as csv and read back in long form."""
    e = table(spark, sf, "events").withColumn("uid", F.col("user_id").cast("string"))
    long = e.groupBy("uid", F.col("event_type").alias("key")).agg((F.count("*") / F.lit(3.0)).alias("value")).withColumn("block", F.lit("E"))
    info = e.groupBy("uid").agg(F.when(F.max("user_id") % 2 == 0, "bot, \"quoted\"").otherwise("human").alias("label"), F.count("*").alias("n"))
    place = staging_place(spark, "wide")
    sinks.write_wide(features.to_wide(long, [("E", k) for k in KINDS], info), place)
    found, back = readers.read_long(spark, place, [("label", "string"), ("n", "long")])
    return back.join(found, "uid").select("uid", "label", "n", "key", "value")


def label_csv_scan(spark, sf):
    """Labels from a csv file whose settings have quotes, commas and line breaks."""
    setting = F.when(F.col("quality") == 0, F.concat(F.lit('says "yes, no"\nto '), "doc_id")).when(F.col("doc_id") % 2 == 0, F.lit("  "))
    place = staging_place(spark, "labels")
    rows = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("user_id"), setting.alias("character_setting"))
    rows.write.csv(place, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.post_labels(spark, place)


def conllu_scan(spark, sf):
    """Words of all texts as token lines among comments, ranges, empty tokens and blanks."""
    bare = F.transform(F.split("text", " "), lambda w: F.regexp_replace(w, r"[\t\n\x0B\f\r ]", ""))
    tagged = F.transform(bare, lambda w, i: F.concat_ws("\t", (i + 1).cast("string"), w, F.lit("_"), F.when(F.char_length(w) % 2 == 0, "DET").otherwise("NOUN")))
    first = F.array(F.concat(F.lit("# doc "), "doc_id"), F.lit("1-2\tboth\t_\tX"), F.lit("1.1\tnone\t_\tX"), F.lit(""), F.lit("9\ttoo few"))
    place = staging_place(spark, "conllu")
    table(spark, sf, "documents").select(F.explode(F.concat(first, tagged)).alias("value")).write.text(place)
    return readers.conllu_words(spark, place).groupBy("word", "upos").agg(F.count("*").alias("n"))


def _tweets(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events")
    zero = lambda t: F.lit(0).cast(t)
    tweets = e.select(
        F.col("event_id").cast("string").alias("tweet_id"), F.when(F.col("user_id") % 17 != 0, F.col("user_id").cast("string")).otherwise("").alias("user_id"), F.lit("bot").alias("label"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.concat(F.lit("a text of some length about "), "props").alias("text"), (F.col("event_type") == "error").cast("int").alias("is_retweet"),
        zero("int").alias("is_quote"), (F.col("event_type") == "click").cast("int").alias("is_reply"), zero("long").alias("retweet_count"), zero("long").alias("favorite_count"),
        zero("int").alias("hashtag_count"), zero("int").alias("url_count"), zero("int").alias("mention_count"), F.lit("").alias("source"),
    )
    users = e.groupBy(F.col("user_id").cast("string").alias("user_id")).agg(F.max("event_type").alias("label"), F.lit("set").alias("dataset"), F.count("*").alias("tweet_count"))
    return users, tweets


def store_scan(spark, sf):
    """Original tweets and their users' labels from the stored tables."""
    place = staging_place(spark, "store")
    sinks.write_store(*_tweets(spark, sf), place)
    return readers.stored_tweets(spark, place).join(readers.stored_users(spark, place).select("user_id", "label"), "user_id")


def store_check(spark, sf):
    """A store beside the same rows, and beside rows of which one field differs."""
    users, _ = _tweets(spark, sf)
    kept = staged(users, "users")
    other = users.withColumn("tweet_count", F.col("tweet_count") + (F.col("user_id") == "1").cast("long"))
    rows = [sinks.same_store(kept, x).select(F.lit(name).alias("name"), "equal") for name, x in (("same", users), ("changed", other))]
    return rows[0].unionAll(rows[1])


def cache_lookup(spark, sf):
    """Hits of a cache whose entries count only if the text is the same, and misses."""
    d = table(spark, sf, "documents").select(F.col("lang").alias("corpus"), F.col("doc_id").cast("string").alias("uid"), "doc_id", "text")
    wanted = audit.fingerprint(d, ["text"])
    parsed = wanted.withColumn("n", F.char_length("text")).select("corpus", "uid", "doc_id", "fingerprint", "n")
    old = parsed.where("doc_id % 5 <> 0").withColumn("fingerprint", F.when(F.col("doc_id") % 3 == 0, "stale").otherwise(F.col("fingerprint")))
    new = parsed.where("doc_id % 6 = 0")
    place = staging_place(spark, "cache")
    sinks.put_cache(sinks.merge_cache(old, new).drop("doc_id"), place)
    cache = spark.read.schema("uid string, fingerprint string, n int, corpus string").parquet(place)
    hits, misses = audit.reuse_cached(wanted.drop("text", "doc_id"), cache)
    return hits.select("uid", F.lit(True).alias("hit"), "n").unionAll(misses.select("uid", F.lit(False), F.lit(None).cast("int")))


def tweet_corpus(spark, sf):
    """Accounts of original tweets: no retweets, no empty account, the latest 200, ten at least."""
    _, tweets = _tweets(spark, sf)
    c = selection.tweets_corpus(tweets.withColumn("seq", F.col("tweet_id").cast("long")), None)
    return c.groupBy("uid").agg(F.count("*").alias("docs"), F.count_if(F.endswith("tag", F.lit("|1"))).alias("replies"), F.sum("seq").alias("seqs"))


def language_scores(spark, sf):
    """Every document by the model of the other half of the documents."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text", (F.col("doc_id") % 2).alias("half"))
    models = [language.fit(d.where(F.col("half") != h)) for h in (0, 1)]
    told = [d.where(F.col("half") == h).select("doc_id", "lang", m.identify(F.col("text")).alias("x")) for h, m in enumerate(models)]
    return told[0].union(told[1]).select("doc_id", "lang", F.col("x.lang").alias("found"), F.round("x.margin", 6).alias("margin"))


def english_accounts(spark, sf):
    """Accounts with ten documents whose joined text is English by a model of all documents."""
    d = table(spark, sf, "documents").select(F.concat("lang", (F.col("doc_id") % 4).cast("string")).alias("uid"), F.col("doc_id").alias("seq"), "text", "lang")
    model = language.fit(d)
    return selection.eligible(selection.latest_posts(d.drop("lang").withColumn("ts", F.lit(""))), model.language).groupBy("uid").agg(F.count("*").alias("docs"))


def _model_sql(texts: str, fitted: str) -> str:
    """CTEs up to ``scored`` (id, lang, score, n): rows of ``texts`` (id, part, t) by the models of
    the rows of ``fitted`` (part, lang, t), part by part."""
    def grams(source: str, keep: str) -> str:
        letters = f"SELECT *, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS i FROM {source} WHERE length(t) > 2"
        return f"SELECT {keep}, (c1 * {language.FIRST} + c2 * {language.SECOND} + c3) % {language.BUCKETS} AS b FROM (SELECT *, unicode(ch)::BIGINT AS c1, lead(unicode(ch)::BIGINT, 1) OVER w AS c2, lead(unicode(ch)::BIGINT, 2) OVER w AS c3 FROM ({letters}) WINDOW w AS (PARTITION BY id, part ORDER BY i)) WHERE c3 IS NOT NULL"

    return f"""
known AS (SELECT part, lang, b, count(*) AS n FROM ({grams(fitted, "part, lang")}) GROUP BY ALL),
sums AS (SELECT part, lang, sum(n) AS all_ FROM known GROUP BY ALL),
asked AS (SELECT id, part, b, count(*) AS n FROM ({grams(texts, "id, part")}) GROUP BY ALL),
scored AS (SELECT id, s.lang, sum(a.n * ln((coalesce(k.n, 0) + 1)::DOUBLE / (all_ + {language.BUCKETS}))) AS score, sum(a.n) AS n FROM asked a JOIN sums s ON s.part = a.part LEFT JOIN known k ON k.part = a.part AND k.lang = s.lang AND k.b = a.b GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, lang) AS rk FROM scored)
""".strip()


def comment_corpus(spark, sf):
    """Comments of accounts that were eligible with all their documents."""
    c = table(spark, sf, "conversations")
    d = c.select((F.col("conv_id") % 20).cast("string").alias("uid"), F.when(F.col("role") == "user", 0).otherwise(1).alias("tag_list"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.lpad(F.col("turn").cast("string"), 4, "0").alias("ts"), "text")
    before = selection.eligible(selection.latest_posts(d), None).select("uid")
    return selection.comments_only(d, before, None).groupBy("uid").agg(F.count("*").alias("docs"), F.sum("seq").alias("seqs"))


def punctuation_check(spark, sf):
    """The ratio to other characters and the share of all order accounts alike."""
    f = doc_features(spark, sf).where("key in ('chars', 'commas')").groupBy("uid", "label").pivot("key", ["chars", "commas"]).agg(F.first("value"))
    two = F.explode(F.array(F.struct(F.lit("M품사").alias("block"), F.lit("PUNCT").alias("key"), (F.col("commas") / (F.col("chars") - F.col("commas"))).alias("value")), F.struct(F.lit("R").alias("block"), F.lit(S.RHYTHM_KEYS[1]).alias("key"), (F.col("commas") / F.col("chars")).alias("value"))))
    long = f.select("uid", "label", two.alias("x")).select("uid", "label", "x.*")
    return significance.punctuation_invariant(significance.mann_whitney(long, ["block", "key"], "value", F.col("label") == "bot"))


def subsample_levels(spark, sf):
    o = table(spark, sf, "orders")
    auc = o.select(F.element_at(F.array(*map(F.lit, S.SUBSAMPLE_LEVELS)), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("level"), (F.col("o_custkey") % 3).alias("seed"), F.when(F.col("o_orderkey") % 3 == 0, "S").otherwise("S−L").alias("name"), F.col("o_totalprice").cast("double").alias("point"), (F.col("o_totalprice") - 150000).cast("double").alias("lo"))
    return rounded(evaluation.subsample_report(auc), "mean_s", "mean_gain", digits=4)


def first_accounts(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("uid"), "doc_id")
    return feature_tables.smoke(d)


def evaluation_set_list(spark, sf):
    """The sets with their keys, codes, worlds and rules."""
    rows = [("-".join(map(str, s.key)), s.code, s.worlds, rule) for s, rule in evaluation.evaluation_sets()]
    return spark.createDataFrame(rows, "set_key string, code long, worlds boolean, rule string")


def checked_subset(spark, sf):
    """Labelled documents, each of which must be a document."""
    l = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.lit(True).alias("_in")), "doc_id", "left")
    return audit.require(l, F.col("_in").isNotNull(), "a labelled document is missing").select("doc_id", "quality")


def path_tolerances(spark, sf):
    e = table(spark, sf, "events")
    path = F.concat(F.when(F.col("event_id") % 3 == 0, "/집합/").otherwise("/other/"), F.col("user_id").cast("string"), F.lit("/W"), (F.col("event_id") % 4).cast("string"), F.lit("x/"), "event_type")
    return e.select("event_id", audit.synthetic_tolerance(path).alias("tolerance"))


def reselected_documents(spark, sf):
    """The latest documents of each account are the same from rows in another order, and not from fewer."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("uid"), F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH").alias("ts"))
    chosen = selection.latest_posts(e)
    again, fewer = selection.latest_posts(e.orderBy(F.desc("seq"))), selection.latest_posts(e.where("seq % 100 <> 0"))
    rows = [selection.same_elements(chosen, x).select(F.lit(name).alias("name"), "equal") for name, x in (("again", again), ("fewer", fewer))]
    return rows[0].unionAll(rows[1])


def call_log_scan(spark, sf):
    """Slot records of a call log with the number of their line. The log is written as files of
    ascending keys, so lines of the files before one are added."""
    kind = F.when(F.col("o_orderkey") % 3 == 0, "기타").otherwise("슬롯")
    line = F.struct(kind.alias("종류"), F.col("o_orderkey").cast("string").alias("슬롯id"), F.col("o_orderstatus").alias("요청모델"), F.col("o_orderpriority").alias("상태"))
    place = staging_place(spark, "calls")
    table(spark, sf, "orders").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select(F.to_json(line).alias("value")).write.text(place)
    files = spark.read.text(place).groupBy(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("source_file")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1))
    above = files.select("source_file", F.coalesce(before, F.lit(0)).alias("above"))
    found = readers.call_records(spark, place).join(F.broadcast(above), "source_file")
    return found.select((F.col("above") + F.col("source_line")).cast("long").alias("source_line"), "slot_id", "model", "status", "comment")


def json_scan(spark, sf):
    """Documents' numbers from JSON files that hold one array of 1,000 at most each."""
    place = staging_place(spark, "json")
    d = table(spark, sf, "documents").select("lang", F.floor(F.col("doc_id") / 1000).alias("part"), F.struct("doc_id", F.char_length("text").alias("n")).alias("d"))
    d.groupBy("lang", "part").agg(F.to_json(F.collect_list("d")).alias("value")).write.partitionBy("lang", "part").text(place)
    return readers.read_json(spark, f"{place}/*/*/*.txt", "doc_id long, n int")


def verification(spark, sf):
    """Leaves that are off by a millionth, which resampled worlds may be and others not."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.sum("value").alias("v"))
    top = F.when(F.col("user_id") % 2 == 0, "/집합/").otherwise("/other/")
    leaf = lambda n: e.select(F.concat(top, F.col("user_id").cast("string"), F.lit("/W2")).alias("path"), F.lit("number").alias("kind"), F.lit(None).cast("string").alias("text"), n.alias("number"))
    return report.verification(leaf(F.col("v") * F.when(F.col("user_id") % 3 == 0, 1 + 1e-6).otherwise(1.0)), leaf(F.col("v")))


def source_tallies(spark, sf):
    """Accounts of each source and of each half, by the seeded split."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    a = d.select(F.col("doc_id").cast("string").alias("uid"), F.when(F.col("quality") == 1, "human").otherwise("bot").alias("label"), "source")
    split, counts = resampling.half_split(a)
    told = spark.createDataFrame([(k, *v.values()) for k, v in counts.items()], "source string, accounts long, development long, confirmation long")
    halves = a.join(split, "uid").groupBy(F.when(F.col("label") == "bot", "bot").otherwise(F.col("source")).alias("source")).agg(F.count_if(F.col("part") == "development").alias("found"))
    return told.join(halves, "source")


def wrong_files(spark, sf):
    """Files whose hash is not the manifest's."""
    place = staging_place(spark, "files")
    n = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).select(F.col("event_type").alias("t"), F.concat_ws(":", "event_type", "n").alias("value"))
    n.coalesce(1).write.partitionBy("t").text(place)
    found = audit.file_hashes(spark, f"{place}/*/*.txt").select("path", "sha256", F.regexp_extract("path", "t=([a-z]+)/", 1).alias("t"))
    # Files of one job share their name, so a path's folder goes into it.
    named = found.withColumn("path", F.concat("path", F.lit("."), "t"))
    want = named.join(n, "t").select("t", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2(F.concat("value", F.when(F.col("t") == "error", "!\n").otherwise("\n")), 256).alias("sha256"))
    return audit.wrong_hashes(named, want).select("t", "found")


_ORIGINAL = "(SELECT event_id, CASE WHEN user_id % 17 <> 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS uid, strftime(ts, '%Y-%m-%d %H:%M:%S') AS made, event_type, props FROM events WHERE event_type <> 'error')"
QUERIES = {
    "wide_csv_scan": (wide_csv_scan, """WITH n AS (SELECT CAST(user_id AS VARCHAR) AS uid, CASE WHEN max(user_id) % 2 = 0 THEN 'bot, "quoted"' ELSE 'human' END AS label, count(*) AS n FROM events GROUP BY user_id),
        k AS (SELECT CAST(user_id AS VARCHAR) AS uid, event_type AS key, count(*) / 3.0::DOUBLE AS value FROM events GROUP BY ALL)
        SELECT n.uid, label, n, t.key, value FROM n CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(key) LEFT JOIN k ON k.uid = n.uid AND k.key = t.key"""),
    "label_csv_scan": (label_csv_scan, "SELECT CAST(doc_id AS VARCHAR) AS uid, CASE WHEN quality = 0 THEN 'bot' ELSE 'human' END AS label FROM labels"),
    "conllu_scan": (conllu_scan, r"""SELECT w AS word, CASE WHEN length(w) % 2 = 0 THEN 'DET' ELSE 'NOUN' END AS upos, count(*) AS n
        FROM (SELECT regexp_replace(unnest(string_split(text, ' ')), '[\t\n\x0B\f\r ]', '', 'g') AS w FROM documents) GROUP BY ALL"""),
    "store_scan": (store_scan, f"""SELECT uid AS user_id, made AS created_at, 'a text of some length about ' || props AS text, CAST(event_type = 'click' AS INT) AS is_reply, label
        FROM {_ORIGINAL} JOIN (SELECT CAST(user_id AS VARCHAR) AS uid, max(event_type) AS label FROM events GROUP BY user_id) USING (uid)"""),
    "store_check": (store_check, "SELECT 'same' AS name, true AS equal UNION ALL SELECT 'changed', (SELECT count(*) FROM events WHERE user_id = 1) = 0"),
    "cache_lookup": (cache_lookup, """WITH c AS (SELECT doc_id, doc_id % 6 = 0 OR (doc_id % 5 <> 0 AND doc_id % 3 <> 0) AS hit, length(text) AS n FROM documents) SELECT CAST(doc_id AS VARCHAR) AS uid, hit, CASE WHEN hit THEN n END AS n FROM c"""),
    "tweet_corpus": (tweet_corpus, f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY made DESC, event_id DESC) AS rn FROM {_ORIGINAL} WHERE uid <> '')
        SELECT uid, count(*) AS docs, count(*) FILTER (WHERE event_type = 'click') AS replies, CAST(sum(event_id) AS BIGINT) AS seqs FROM l WHERE rn <= 200 GROUP BY uid HAVING count(*) >= 10"""),
    "language_scores": (language_scores, f"""WITH d AS (SELECT doc_id AS id, lang, doc_id % 2 AS half, lower(text) AS t FROM documents), asks AS (SELECT id, half AS part, t FROM d), fits AS (SELECT id, 1 - half AS part, lang, t FROM d WHERE lang IS NOT NULL),
        {_model_sql("asks", "fits")} SELECT d.id AS doc_id, d.lang, max(p.lang) FILTER (WHERE rk = 1) AS found, round((max(score) FILTER (WHERE rk = 1) - max(score) FILTER (WHERE rk = 2)) / any_value(n), 6) AS margin FROM d LEFT JOIN placed p ON p.id = d.id GROUP BY ALL"""),
    "english_accounts": (english_accounts, f"""WITH d AS (SELECT lang || (doc_id % 4) AS uid, doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY uid ORDER BY doc_id DESC) <= 200),
        a AS (SELECT uid AS id, 0 AS part, count(*) AS docs, lower(string_agg(text, ' ' ORDER BY doc_id)) AS t FROM d GROUP BY uid), fits AS (SELECT doc_id AS id, 0 AS part, lang, lower(text) AS t FROM documents),
        {_model_sql("a", "fits")} SELECT a.id AS uid, docs FROM a JOIN placed p ON p.id = a.id AND rk = 1 WHERE docs >= 10 AND p.lang = 'en'"""),
    "comment_corpus": (comment_corpus, """WITH d AS (SELECT CAST(conv_id % 20 AS VARCHAR) AS uid, role, conv_id * 1000 + turn AS seq, turn FROM conversations),
        before AS (SELECT uid FROM (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY turn DESC, seq DESC) AS rn FROM d) WHERE rn <= 200 GROUP BY uid HAVING count(*) >= 10),
        own AS (SELECT d.*, row_number() OVER (PARTITION BY uid ORDER BY turn DESC, seq DESC) AS rn FROM d WHERE role <> 'user' AND uid IN (SELECT uid FROM before))
        SELECT uid, count(*) AS docs, CAST(sum(seq) AS BIGINT) AS seqs FROM own WHERE rn <= 200 GROUP BY uid HAVING count(*) >= 10"""),
    "punctuation_check": (punctuation_check, f"""WITH {_DOC.strip().split("f AS (SELECT uid, label, 'F'")[0].rstrip().rstrip(',')}, f AS (SELECT uid, label, 'M' AS block, 'PUNCT' AS key, c / (n - c) AS value FROM d UNION ALL SELECT uid, label, 'R', 'share', c / n FROM d),
        {_MW.strip()} SELECT count(*) = 2 AND count(DISTINCT u) = 1 AND count(DISTINCT delta) = 1 AS holds FROM mw"""),
    "subsample_levels": (subsample_levels, """WITH a AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 50 WHEN 1 THEN 25 WHEN 2 THEN 10 ELSE 5 END AS level, o_custkey % 3 AS seed, o_orderkey % 3 = 0 AS s, o_totalprice::DOUBLE AS point, (o_totalprice - 150000)::DOUBLE AS lo FROM orders)
        SELECT level, round(avg(point) FILTER (WHERE s), 4) AS mean_s, round(avg(point) FILTER (WHERE NOT s), 4) AS mean_gain, count(*) FILTER (WHERE NOT s AND lo > 0) AS positive, count(DISTINCT seed) AS draws FROM a GROUP BY level"""),
    "first_accounts": (first_accounts, "SELECT source AS uid, doc_id FROM documents WHERE source IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 3)"),
    "evaluation_set_list": (evaluation_set_list, f"""WITH s(i, name) AS (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(sorted(evaluation.SOURCES)))})
        SELECT '501' AS set_key, 501::BIGINT AS code, true AS worlds, 'true' AS rule UNION ALL SELECT '531', 531, true, 'trunc: true' UNION ALL SELECT '541', 541, true, 'not excluded'
        UNION ALL SELECT CAST(511 + i AS VARCHAR), 511 + i, false, 'label = ''bot'' or source = ''' || name || '''' FROM s UNION ALL SELECT CAST(521 + i AS VARCHAR), 521 + i, false, 'label = ''bot'' or source <> ''' || name || '''' FROM s
        UNION ALL SELECT (600 + level) || '-' || seed, NULL, false, 'label = ''human'' or chosen_' || level || '_' || seed FROM (VALUES (50), (25), (10), (5)) l(level) CROSS JOIN (VALUES (0), (1), (2)) r(seed)"""),
    "checked_subset": (checked_subset, "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)"),
    "path_tolerances": (path_tolerances, "SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 4 IN (2, 3) THEN 1e-3 ELSE 1e-10 END::DOUBLE AS tolerance FROM events"),
    "reselected_documents": (reselected_documents, "SELECT 'again' AS name, true AS equal UNION ALL SELECT 'fewer', (SELECT count(*) FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d %H') DESC, event_id DESC) AS rn FROM events) WHERE rn <= 200 AND event_id % 100 = 0) = 0"),
    "call_log_scan": (call_log_scan, """WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS line FROM orders)
        SELECT line AS source_line, CAST(o_orderkey AS VARCHAR) AS slot_id, o_orderstatus AS model, o_orderpriority AS status, CAST(NULL AS VARCHAR) AS comment FROM n WHERE o_orderkey % 3 <> 0"""),
    "json_scan": (json_scan, "SELECT doc_id, length(text) AS n FROM documents"),
    "verification": (verification, """SELECT count(*) FILTER (WHERE u % 3 = 0 AND u % 2 <> 0) = 0 AS passed, count(*) FILTER (WHERE u % 3 = 0 AND u % 2 <> 0) AS off, count(*) FILTER (WHERE u % 3 = 0 AND u % 2 = 0) AS loose
        FROM (SELECT user_id AS u FROM events GROUP BY user_id HAVING sum(value) <> 0)"""),
    "source_tallies": (source_tallies, """WITH a AS (SELECT CASE WHEN quality = 1 THEN source ELSE 'bot' END AS source FROM documents JOIN labels USING (doc_id))
        SELECT source, count(*) AS accounts, count(*) // 2 AS development, count(*) - count(*) // 2 AS confirmation, count(*) // 2 AS found FROM a GROUP BY source"""),
    "wrong_files": (wrong_files, "SELECT 'error' AS t, sha256('error:' || count(*) || chr(10)) AS found FROM events WHERE event_type = 'error'"),
}
