"""Five stages from raw documents to packed training sequences.

Each stage gets what its predecessor kept, written as Parquet and read again. All but the last return
the columns of ``documents``: quality rules reject documents, near-duplicate groups are cut to one
document, documents with benchmark items go, personal data are replaced in the texts, and the rest is
packed into sequences of tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from noticeframe.llm import decontam, nearcopies, packing, pii, quality
from noticeframe.llm.common import shared_folder
from noticeframe.llm.queries import tokenizer_file


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9. Documents with a posterior of good quality under 0.5, or that fail the base rule, go."""
    return quality.good_documents(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3, with its wider search for five-word shingles. The document with the smallest id of each group stays."""
    return nearcopies.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5. Documents that contain a benchmark item go."""
    return decontam.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2. Every span found is replaced by its kind; no document goes."""
    return pii.redact(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. One row per piece of a document, with its sequence and offset."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", keep_uncontaminated),
    ("pii", redact_personal_data),
    ("packing", pack_tokens),
]

#: SQL has no XXH64 with a seed and no tokeniser; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is removed once it is used."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for n, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(at)
        if last is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        docs, last = spark.read.parquet(at), at
    return docs
