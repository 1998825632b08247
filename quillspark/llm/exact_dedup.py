"""Exact dedup by progressive refinement, in DataFrame functions only.

Rows are grouped by the length of the normalised text, then by a hash of its first characters, then by a full digest.
Each step works only on rows whose group of the step before has more than one row. The texts are read once for lengths
and prefix hashes, and once more for the digests of surviving rows; where every row is to have its digest, both come
from one pass. Groups are counted with partial aggregation, so a group that holds a third of all rows costs each task
one row; groups of more than HOT_GROUP rows are few and broadcast to their rows, the others meet theirs in an equi-join
of small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import bounded, stored

#: The characters that normalisation deletes: blank, tab, line feed, vertical tab, form feed, carriage return.
DELETED = " \t\n\x0b\x0c\r"
#: Rows of a key table up to which it may be broadcast (three 8-byte columns each).
BROADCAST_ROWS = 100_000
#: Rows of a group beyond which it is broadcast; more, where there are more than BROADCAST_ROWS such groups.
HOT_GROUP = 1000


def normalised(text: Column) -> Column:
    """The text without white space; byte-level replaces are several times faster than a regular expression here."""
    for c in DELETED:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical after deleting white space; null counts as empty, and empty texts are equal to each
    other. Of equal texts the one with the most code points in the original stays, on a tie the smallest id. Rows that
    repeat an id with equal text all carry keep_id; only one of them could be told from the other by nothing, so each
    says kept if its id is keep_id. digest is the SHA-256 of the normalised text: of rows that reach the last step, or
    of all rows with digest_all. Of texts of one length a null id is never kept over a known one; ids may be of any type that
    has an order. No rows give no rows.
    """
    base = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")).select(
        "doc_id", F.length("text").alias("n_chars"), normalised(F.col("text")).alias("norm")
    )
    full = F.sha2("norm", 256)
    head = F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("head")
    headed = base.select("doc_id", "n_chars", F.octet_length("norm").alias("n_norm"), head, "norm", full.alias("digest"))
    rows = stored(headed.drop("norm") if digest_all else headed.drop("norm", "digest"), "lengths-and-heads")
    # 1: lengths that occur more than once
    lengths = bounded(stored(rows.groupBy("n_norm").agg(F.count("*").alias("n")).where("n > 1").select("n_norm"), "lengths"), BROADCAST_ROWS)
    # 2: of those, (length, prefix hash) pairs that occur more than once
    heads = rows.join(lengths, "n_norm", "left_semi").groupBy("n_norm", "head").agg(F.count("*").alias("n")).where("n > 1")
    heads = bounded(stored(heads.select("n_norm", "head", F.lit(True).alias("deep")), "heads"), BROADCAST_ROWS)
    # 3: the full digest, of the rows of those pairs; with digests of all rows, those of other rows are equal to none
    if digest_all:
        deep, last = rows.join(heads, ["n_norm", "head"], "left_semi"), rows.select("doc_id", "n_chars", "digest")
    else:
        last = headed.drop("digest").join(heads, ["n_norm", "head"], "left")
        last = stored(last.select("doc_id", "n_chars", F.when(F.col("deep"), full).alias("digest")), "digests")
        deep = last.where("digest IS NOT NULL")
    rank = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id")
    groups = deep.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(rank).alias("best"))
    groups = stored(groups.where("group_size > 1").select("digest", "group_size", F.col("best.doc_id").alias("keep_id")), "groups")
    # the larger groups are the fewer: raise the limit until so few are left that they may be broadcast
    hot = HOT_GROUP
    while BROADCAST_ROWS and groups.where(F.col("group_size") > hot).limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        hot *= 8
    large = F.broadcast(groups.where(F.col("group_size") > hot).toDF("digest", "hot_size", "hot_id"))
    small = groups.where(F.col("group_size") <= hot).withColumnRenamed("digest", "meet")
    # rows that have their group already are spread over all tasks under keys that no group has
    spread = F.concat(F.lit("-"), F.xxhash64(F.col("doc_id").cast("string")).cast("string"))
    found = last.join(large, "digest", "left").withColumn("to", F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(spread))
    found = found.join(small, F.col("to") == F.col("meet"), "left").withColumn("keep_id", F.when(F.col("hot_size").isNull(), F.col("keep_id")).otherwise(F.col("hot_id")))
    found = found.withColumn("group_size", F.coalesce("hot_size", "group_size"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), "digest",
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from quillspark.llm._spark import table

    found = exact_duplicates(table(spark, sf_dir, "documents"), digest_all=True)
    return found.withColumnRenamed("digest", "text_sha256")


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (SELECT *, sha256(norm) AS text_sha256 FROM t)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
  text_sha256
FROM g
"""
