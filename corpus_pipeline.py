"""From raw documents to a mixed, encoded corpus: five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``docs``, whatever others there are beside doc_id, text and source.
An empty table stays empty. Of tables between stages only the last is kept, which the result reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylume.llm import block_naming, mixing, ngram_join, sentencepiece_codec, toxicity
from querylume.llm.common import delete, shared_dir, table

#: No SQL: the first stage's learned scores, MinHash candidates and the tokenizer have none.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Null and empty texts stay; rows that repeat stay or go together; without labels
    all stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the one with the most code points stays, then the one with the
    smallest id (a null id comes first). Null text counts as empty, and all empty texts are equal. Of rows that repeat one
    stays."""
    return block_naming.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that n-gram Jaccard links connect, the one with the smallest id stays (a null id comes first; of
    different texts with that id the one with the smallest hash). Texts without words have no links and stay. Of rows that
    repeat one stays."""
    return ngram_join.keep_one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, 0 to 3. A document without words isn't taken. A null source is a
    source of its own, the last. Ties between documents of one source and length go by a seeded hash of the id."""
    return mixing.take_mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's SentencePiece ids, with what verifies them: doc_id, n_pieces, ids_crc32, parity, round_trip, ids. A null
    text counts as empty. Rows that repeat are encoded each."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.model_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/pipeline-{i}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                delete(spark, before)
            before = path
    return docs.select("doc_id", "n_pieces", "ids_crc32", "parity", "round_trip", F.col("ids"))
