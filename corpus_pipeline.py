"""A training corpus in five stages: good texts, one of each near-duplicate group, without long repeats, mixed, and encoded.

Every stage takes all rows that the one before it kept. All but the last return
the columns of ``documents``, and other columns of any name too. Null and empty
texts and repeated rows pass through every stage by the rules of its operator. The mixture's decision is the order of the rows.
A scan does not keep the order of files, so the last stage takes each row's place
from its file's number and its row in the file, and returns it with the encoded
texts as ``position``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm import bpe, mixing, quality, simhash, suffixes
from clausegrid.llm.common import remove, stored_at

#: Bits of a position for the row within a file and the file within a task.
_ROW_BITS, _FILE_BITS = 30, 13


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws; the others go."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group one row, that with the smallest doc_id: shingles of five words, five differing bits at most."""
    return simhash.one_of_each_group(docs, width=5, max_bits=5)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their long repeated strings."""
    return suffixes.texts_without_repeats(docs)


def in_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """position, doc_id, n_tokens, ids (little-endian 32-bit integers) and the digest of the bytes that they decode to.

    Positions rise in the order in which the rows were written, with gaps between
    files: by the task's number, the file's number within the task, and the row's
    within the file. The file's number stands before its ending; a part of the
    random name that looks like one does not count. ``docs`` must be Parquet files as they are read, with
    nothing between. Null and empty texts have no ids; rows may repeat, and other
    columns are ignored.
    """
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0))
    task, file, row = number(r"^part-(\d+)"), number(r"[-.]c(\d+)(?:\.|$)"), F.col("_metadata.row_index")
    whole = F.shiftleft(task, _ROW_BITS + _FILE_BITS) + F.shiftleft(file, _ROW_BITS) + row
    fits = (task < 1 << 63 - _ROW_BITS - _FILE_BITS) & (file < 1 << _FILE_BITS) & (row < 1 << _ROW_BITS)
    placed = docs.withColumn("position", F.when(fits, whole).otherwise(F.raise_error(F.lit("too many files or rows for a position")).cast("long")))
    return bpe.encoded(placed, keep=("position",)).select("position", "doc_id", "n_tokens", "ids", "decoded_sha256")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", without_near_duplicates),
    ("suffix-array dedup", without_repeats),
    ("mixing sources", in_mixture),
    ("byte-level BPE", encoded),
]

#: SQL cannot express the hashed models, fingerprints and merges; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again, and removed when the next one is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored_at(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
