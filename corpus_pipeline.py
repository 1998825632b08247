"""A corpus from raw documents to token files, in five stages; part of quillspark.llm.

Each stage gets what its predecessor wrote and returns the columns of documents, the last one a row per encoded
document. In every stage a null or empty text is a text without words or tokens, a null id is an id like any other
unless said otherwise, repeated rows are rows of their own unless said otherwise, very long texts are worked on whole,
an empty table gives an empty table, and further columns, whatever their names, stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, jaccard_join, mixing, token_output, toxicity
from quillspark.llm._spark import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold: ties with it go. Null and empty texts have a score too,
    rows that repeat a text have the same one, and without labels all stay."""
    return toxicity.clean_rows(docs, table(spark, sf_dir, "labels"), held_out=toxicity.mod3_is_1)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates; of rows that repeat that id one stays. Texts
    without words and rows with a null id are linked with nothing and stay."""
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Texts without words stay, and an empty benchmark keeps all;
    null or empty items are never found."""
    return decontamination.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights, in random order: the files that are written from this hold
    ranges of a random key, ascending. Rows that repeat an id are drawn alike; a null source is a source of its own."""
    return mixing.mix(docs, marks=False)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per encoded document, read back from the compressed token files: doc_id, start, n_tokens, ids_crc32.

    Documents are written in the order that they come in, so that copies of one stay apart and nothing is shuffled
    again. A null text has the end id alone.
    """
    return token_output.read_documents(token_output.write_frames(docs, by_id=False))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: SQL cannot express the toxicity model; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
