"""Bounded samples of labelled rows, for fitting models on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import is_held_out

#: About the most bytes of one text that a sample holds: with the number of rows it bounds what the driver holds.  Of a
#: longer text the sample has PARTS stretches of equal length, spread evenly from its start to its end.
LONGEST, PARTS = 32 << 10, 8


def labelled_ids(labels: DataFrame, label: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """id and label of at most ``rows`` rows of each label 0 and 1: those whose ids' hashes are least among labelled
    rows that aren't held out.  Rows with null ids or labels are passed over; of an id's labels the greater counts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    known = known.filter(~is_held_out(F.col("id")))
    order = [F.xxhash64("id"), F.col("id")]
    return known.filter("label = 0").orderBy(*order).limit(rows).unionByName(known.filter("label = 1").orderBy(*order).limit(rows))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> pa.Table:
    """text and label of the documents of labelled_ids(); texts over ``longest`` bytes by stretches, null texts not."""
    return texts(documents, labelled_ids(labels, label, rows, id_col), "label", id_col, text_col, longest)


def shortened(text: Column, longest: int) -> Column:
    """The text, or of one of more than ``longest`` bytes PARTS stretches spread over it, a line each."""
    chars, size = F.length(text), F.octet_length(text)
    each = F.greatest(F.lit(1), F.floor(F.lit(longest // PARTS) * chars / size)).cast("int")
    parts = [F.substring(text, (F.floor((chars - each) * k / (PARTS - 1)) + 1).cast("int"), each) for k in range(PARTS)]
    return F.when(text.isNotNull() & (size > longest), F.concat_ws("\n", *parts)).otherwise(text)


def texts(documents: DataFrame, some: DataFrame, label: str, id_col: str, text_col: str, longest: int) -> pa.Table:
    """Text and label of the documents in ``some`` (id, label), whose size is bounded; in a fixed order."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    found = rows.join(F.broadcast(some), "id").select("id", shortened(F.col("text"), longest).alias("text"), label)
    return found.toArrow().sort_by([("id", "ascending"), ("text", "ascending")]).select(["text", label])
