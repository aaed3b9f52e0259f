"""From raw documents to packed sequences: each stage's result is the next one's input.

1. quality: documents that a rule rejects, or that a rejected host holds, go.
2. near_duplicates: one document of each group of near copies stays (five-word shingles of
   similarity 0.8 or more, proposed by fingerprints' tries and min-hashes).
3. personal_data: spans of personal data in the texts give way to their kind in brackets.
4. packing: documents become pieces of sequences of at most 4096 tokens.

All but the last stage return the columns of ``documents``. Each handles null texts and ids,
repeated rows and empty tables as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import near_copies, packing, pii, quality, shared, simhash

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Executors of a pipeline still hold what earlier stages took, so packing takes less here.
MEMO_CHUNKS = 150_000
BATCH_CHARS = 2 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, every_rule=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, near_copies.near_copies)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID, memo_chunks=MEMO_CHUNKS, batch_chars=BATCH_CHARS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Token ids can't be had in SQL; tests/llm compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.dealt(shared.table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
