"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.llm import linededup, mixing, packing, simhash, toxicity
from quern.llm.common import held_out, shared_folder, table
from quern.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject (operator 9). A text's score decides, also for those without one."""
    scored = toxicity.with_toxicity(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), ~held_out(5, 0))
    return scored.where("toxicity = 0").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines (operator 6, matches extended both ways); n_chars follows. Every row stays."""
    return linededup.dedup_lines(docs.select(*COLUMNS)).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard index of 0.8 or more), that of the smallest doc_id."""
    return simhash.keep_one_near(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in shuffled order (operator 3)."""
    return mixing.replicated(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences (operator 8)."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("simhash near-dedup", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]

# No SQL can train a classifier or run the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def _gone(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again. Only the last one's rows stay there."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _gone(spark, f"{folder}/{k - 1}")
    return docs
