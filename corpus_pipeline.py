"""A corpus pipeline: toxicity, exact copies, near copies, benchmark passages, and token ids of what is left.

Every stage takes all rows that its predecessor kept, with whatever columns they have, and all but the last return
these columns with the values they had. Null texts count as empty, null ids as the smallest; an empty table, of
documents, labels or items, goes through and gives an empty result or drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithograph.llm.common import materialize, release, table
from lithograph.llm.decontaminate import drop_contaminated
from lithograph.llm.exact_dedup import drop_exact_copies
from lithograph.llm.near_dedup import drop_near_copies
from lithograph.llm.sentencepiece_codec import encode_decode
from lithograph.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on labelled ones among docs, rejects; without labels none. Rows of one id are judged each by its text."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts, white space aside, the document with the smallest id; of rows that repeat both, one."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each class of near-duplicates; of several texts with that id, one."""
    return drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark; rows of one id go together. Items without words are in nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again and compared: a row for each row, in any order."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("benchmark passages", benchmark_passages),
    ("token ids", token_ids),
]

#: The classifier and the samplings of the stages are beyond SQL; tests/llm holds a brute-force version of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read by the next; what a stage has read then goes."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-stage")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
