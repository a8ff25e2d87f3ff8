"""Documents to packed training sequences, in stages that each read their predecessor's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import line_dedup, mixing, near_dedup, packing, quality
from quillmark.llm.common import Workspace, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the language model reject go.

    Rows alike in text and language stay or go together; nulls are judged as
    empty texts. Columns keep their values, whatever their names.
    """
    return quality.keep_good(docs, Workspace(spark, "stage-quality"))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of three documents or more stay in the last of them only; n_chars follows.

    Null texts stay null. Rows keep their number and their other columns.
    """
    out = line_dedup.dedup_lines(docs, Workspace(spark, "stage-lines"))
    text = F.when(F.col("doc.text").isNotNull(), F.col("kept_text"))
    new = {"text": text} | ({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: one with the smallest doc_id of the group.

    Near-duplicates share 80 % of their shingles of five words. Rows without a
    word or with a null doc_id stay; of repeated rows one stays.
    """
    ws = Workspace(spark, "stage-near")
    rows = ws.save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("doc")), "rows")
    found = near_dedup.near_duplicates(rows.select("row", "doc.doc_id", "doc.text"), ws, size=5, percent=80, row="row")
    gone = ws.save(found.where("not first").select("row"), "gone")
    return rows.join(gone, "row", "left_anti").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; a source's budget may cut one row.

    Rows without a word aren't taken. A null source is a source.
    """
    return mixing.mixed(docs, Workspace(spark, "stage-mix"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row; rows with null text have one id."""
    return packing.pack(docs, Workspace(spark, "stage-pack"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", lines_once),
    ("near dedup", one_of_each_group),
    ("mix sources", mix_sources),
    ("pack", pack_sequences),
]
#: The language model and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return ws.save(STAGES[-1][1](spark, docs, sf_dir), "packed")
