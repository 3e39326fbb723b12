"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A caller may write each result and read it again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm import jaccard_join, line_dedup, mixing, pieces, quality_rules
from duskwatch.llm.store import cut, documents


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failed lines, and with all columns.

    Null and empty texts, and any with fewer than ten words, are rejected. Repeated rows stay or go together,
    ids may be null or repeat, an empty table gives an empty one, columns of any name are kept; a very long
    text is judged whole.
    """
    return quality_rules.keep_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns, the texts without lines that match an earlier line, kept or not.

    Null texts stay null; a text whose lines all go is empty. Of rows with equal id and text all lose the
    same lines. Rows without an id rank last, ties of ids are broken by digests of the text. An empty table
    gives an empty one; columns of any name are kept; a very long text is taken line by line.
    """
    return line_dedup.remove(docs)


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five words, 0.8), by its id, with all columns.

    Rows that share an id stay or go together. Rows without an id, and null, empty and blank texts, which
    link with nothing, stay. An empty table gives an empty one; columns of any name are kept.
    """
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice, with all columns.

    A null or empty text has size 0 and is not taken. Sources may be null; repeated rows are drawn each for
    itself; reruns agree. An empty table gives an empty one; columns of any name are kept.
    """
    packed = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source")  # own columns can't clash with those of the mix
    mixed = mixing.mix(packed, ("_row",)).where("copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids) of each row; null and empty texts have no ids, an empty table gives no rows,
    other columns are not read, words and texts of any length are encoded whole."""
    return pieces.encode(docs).select("doc_id", F.size("ids").alias("n_pieces"), "ids")


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_alike),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Digests, random rounding and merges of pieces can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what goes from one to the next is written to the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
