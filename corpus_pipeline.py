"""A corpus pipeline of operators; each stage is written as Parquet and read again as the next one's documents.

When a stage begins, its predecessor's result over the same tables has been written, so it deletes the tables that one worked with.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tracequarry.llm import mixing, ngram_jaccard, quality_rules, sentencepiece_codec, suffix_dedup
from tracequarry.llm.common import delete_tables, recorded, table, write_shared
from tracequarry.llm.queries import vocabulary

#: Tables that a stage (of a folder of tables) worked with and its result still reads.
_worked_with: dict[tuple[str, str], list[str]] = {}


@contextmanager
def _stage(spark: SparkSession, sf_dir: str, name: str, before: str | None):
    delete_tables(spark, _worked_with.pop((sf_dir, before), []))
    with recorded() as tables:
        yield
    _worked_with[sf_dir, name] = tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the text rules and whose host is not rejected."""
    with _stage(spark, sf_dir, "quality", None):
        return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    with _stage(spark, sf_dir, "near_duplicates", "quality"):
        return ngram_jaccard.keep_one_of_each(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that also occur elsewhere."""
    with _stage(spark, sf_dir, "repeated_passages", "near_duplicates"):
        return suffix_dedup.remove_repeats(docs)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring domains down to their target weights."""
    with _stage(spark, sf_dir, "target_weights", "repeated_passages"):
        return mixing.mixture(docs, table(spark, sf_dir, "labels"), ceilings=True)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and decoded text of each document."""
    with _stage(spark, sf_dir, "encoding", "target_weights"):
        return sentencepiece_codec.encode_pieces(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", target_weights),
    ("SentencePiece encoding and decoding", encoding),
]
#: Removing repeated strings and encoding are no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, written = write_shared(stage(spark, docs, sf_dir), "stage")
        delete_tables(spark, [path] if path else [])
        path = written
    delete_tables(spark, _worked_with.pop((sf_dir, STAGES[-1][1].__name__), []))
    return docs
