"""The corpus pipeline: documents in, packed training sequences out.

language        documents whose language can't be told with confidence go
near_duplicates one document of each group of near-duplicates (five-word shingles, 0.8) stays
secrets         found secrets are replaced in the texts; no document goes
mixing          whole documents are repeated or left out to meet the sources' target weights, in training order
packing         token pieces of all documents with their places in sequences and in the training order

Every stage works on all rows of the one before, which are written to the shared folder first. Null
and empty texts, repeated rows and empty tables are handled as each operator's module says. In the result
`position` is the number of a row of the mix (a document comes once for each pass), `pass` counts a document's
passes from 0 (a document is a row, known by all its columns), and `sequence_position` is the mean position of
a sequence's tokens: sequences sorted by it follow the curriculum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import language, mixing, near_duplicates, packing, secrets
from graphloom.llm.common import column, documents, free, row_mark, written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.learned(docs, language.held_out(docs["doc_id"], 5) != 0)
    found = language.identified(docs, model)
    mark = found.columns[-1]
    return found.filter(~F.col(f"{mark}.rejected")).drop(mark)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.deduplicated(docs, size=5)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scanned(docs)
    text = secrets.redacted(F.col("text"), F.col(found.columns[-1]))
    changed = found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return changed.select(*[column(changed, c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.curriculum(docs)


def in_file_order(docs: DataFrame) -> tuple[Column, Column]:
    """Files of a written table are in the order of their names, rows in the order they were written."""
    return F.col("_metadata.file_name"), F.col("_metadata.row_index")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs must be a table read from Parquet, whose order of rows is the training order."""
    file, row = in_file_order(docs)
    name = free(docs, "_file")
    counts = docs.select(file.alias(name)).groupBy(name).count()
    # One number for each file, by its name.
    before = F.coalesce(F.sum("count").over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(name, before.alias(free(docs, "_start")))
    placed = docs.withColumns({name: file, free(docs, "_row"): row}).join(F.broadcast(starts), name)
    position = (F.col(free(docs, "_start")) + F.col(free(docs, "_row"))).cast("long")
    pieces = packing.pieces_of(placed, position=position, mark=row_mark(docs))
    packed = packing.packed(pieces, order=("position", "piece"))
    passes = F.dense_rank().over(Window.partitionBy("mark").orderBy("position")) - 1
    mean = F.sum(F.col("position") * F.col("length")).over(Window.partitionBy("sequence_id")) / F.sum("length").over(Window.partitionBy("sequence_id"))
    return packed.withColumns({"pass": passes, "sequence_position": mean}).drop("mark")


STAGES = [
    ("language", languages),
    ("near_duplicates", near_duplicate_groups),
    ("secrets", secret_spans),
    ("mixing", mix),
    ("packing", sequences),
]
#: Trained models, signatures and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
