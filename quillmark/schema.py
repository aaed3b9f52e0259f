"""Table schemas, the feature-key dimension and the fixed values of the analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Limits, seeds and names that results must agree with.
SEED = 20260926
MATCH_SEED = 20260827
SPLIT_SEED = 20260101
WORLD_SEED = 20260101
EXPERIMENT = 17
CALIPER = 0.10
NOTABLE_DELTA = 0.147
NOTABLE_Q = 0.05
MIN_DOCS = 10
MAX_DOCS = 200
MIN_CHARS = 20
MIN_SENTENCES_CV = 5
RATE_DIGITS = 6
PERMUTATIONS = 10_000
BOOTSTRAPS = 2_000
EXTRA_DRAWS = 4
NEIGHBOURS = 10
RESIDUAL_CAP = 5.0
RELATIVE_SLACK = 1e-12
SUBSAMPLE_LEVELS = (50, 25, 10, 5)
SUBSAMPLE_SEEDS = (0, 1, 2)
TARGET_LANGUAGE = "en"
CLOSED_CLASSES = ("ADP", "AUX", "CCONJ", "SCONJ", "DET", "PRON", "PART")
FAMILIES = ("F", "M형태", "M품사", "R")
BLOCKS = {"F": ("F",), "M": ("M형태", "M품사"), "R": ("R",)}
RHYTHM_KEYS = ("문장당_토큰수", "구두점_비율", "문장길이_변동계수")
COUNT_COLUMNS = ("문서수", "문장수", "토큰수", "토큰수_구두점제외")
UNLABELLED = "라벨없음"
REASON_EMPTY = "빈 문자열"
REASON_NOTHING_LEFT = "자기폭로 절제 후 내용 없음"
REASON_SHORT = "20자 미만"
EXCISED_PREFIX = "자기폭로 절제 후 "
STATUS_NEW = "신규주목"
STATUS_NEITHER = "기준선비주목"
STATUS_UNTESTABLE = "검정불가"
STATUS_REVERSED = "방향역전"
STATUS_BELOW = "효과문턱미달"
STATUS_KEPT = "효과유지"
SCALE_MEDIAN = "중앙값"
SCALE_MEAN = "평균"
SCALE_ZERO = "제외_0"
SCALE_UNDEFINED = "제외_정의2미만"
SELF_REVEAL = r"as an ai language model|i'?m sorry,? but (i cannot|as an ai)|i cannot (comply|fulfill|browse)|openai'?s? (content )?polic"
EXCLUDED_PHRASES = ("i'm sorry", "as an ai", "openai", "language model")

DOCS = "corpus string, uid string, seq long, ts string, text string, tag string"
TOKENS = "uid string, doc long, sent int, tok int, form string, upos string, feats string"
LONG = "uid string, block string, key string, value double"
KEYS = "ord int, block string, key string, axis string, axis_card int"
USERS = "user_id string, label string, dataset string, tweet_count long"
TWEETS = ("tweet_id string, user_id string, label string, created_at string, text string, is_retweet int, is_quote int, "
    "is_reply int, retweet_count long, favorite_count long, hashtag_count int, url_count int, mention_count int, source string")


def key_dimension(spark: SparkSession, keys: dict[str, list[str]], axis_map: dict[str, list[str]]) -> DataFrame:
    """The ordered feature keys with their axis and its number of values; a few hundred rows
    from a schema file, fit to be broadcast."""
    rows, n = [], 0
    for family in FAMILIES:
        for key in keys.get(family, []):
            axis = key.split("=", 1)[0] if family == "M형태" else None
            rows.append((n, family, key, axis, len(axis_map.get(axis, ())) if axis else None))
            n += 1
    return spark.createDataFrame(rows, KEYS)
