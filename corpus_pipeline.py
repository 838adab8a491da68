"""A training corpus from ``documents``: quality, near-duplicates, benchmark decontamination, personal data, mix.

Every stage works on all rows that its predecessor kept; all but the last return the columns of ``documents``. A stage's result is written
to the shared folder and read again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ondula.llm import decontamination, mixing, pii, quality, queries, simhash
from ondula.llm.common import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with names that no operator gives to its own columns."""
    return docs.select(*[F.col(f"`{c}`").alias(f"own_{c}") for c in docs.columns])


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`own_{c}`").alias(c) for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at ``queries.GOOD`` or more; it learns from the labelled rows of the given documents, and keeps all where there are none."""
    labels = queries.table(spark, sf_dir, "labels").where(~quality.held_out("doc_id", 4, 2))
    weights = quality.fit(docs, labels)
    return docs.where(quality.score(F.col("text"), weights, docs) >= queries.GOOD) if quality.learnt(weights) else docs


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates; different texts that share an id stay."""
    return simhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontamination.contamination(_apart(docs), queries.table(spark, sf_dir, "benchmark"), text="own_text")
    return _back(found.where("n_hit = 0"), docs)


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; ``n_chars`` is that of the new text. The key is the session's ``spark.ondula.pii.key``."""
    done = pii.pseudonymise(_apart(docs), spark.conf.get("spark.ondula.pii.key", queries.PII_KEY), text="own_text")
    if "n_chars" in docs.columns:
        done = done.withColumn("own_n_chars", F.length("own_text").cast(docs.schema["n_chars"].dataType))
    return _back(done, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy that is taken, with ``size``, ``source_size``, ``target``, ``copies``, ``taken``, ``finish`` and ``epoch``."""
    return mixing.emitted(mixing.mix(docs, mixing.cyclic_weights(docs, queries.WEIGHTS)))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("pii", pseudonymous),
    ("mix", mixed),
]

#: The fitted classifier has no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
