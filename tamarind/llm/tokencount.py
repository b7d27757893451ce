"""Token counts of flat token files, by a vectorised scan for the end-of-document id.

A token file is ids only, two bytes each (four, if the vocabulary needs them), every document followed by the separator; there is no index.  A file is cut into
blocks of fixed size, whatever documents they cut.  Each block is searched for separators in one vectorised comparison
and gives its inner documents' lengths and its first and last separator.  A prefix scan over a file's blocks
(separators before the block; last separator before it) then numbers the documents and completes those that cross
blocks, however many blocks one fills.

Special input: null and empty texts count 0; special tokens' strings in a text are ordinary text, so a separator
is always a document's end; a text of any length is encoded whole and may fill many blocks; repeated rows are counted one by one; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .encoding import encoder
from .warc import rename, store
from .workspace import new_dir, slices, stored

SEPARATOR = 49407
BLOCK = 4 << 20


def id_type(tokenizer: str, separator: int) -> str:
    """Two bytes an id where all ids and the separator fit, else four."""
    return "<u2" if max(encoder(tokenizer, False).library.get_vocab_size() - 1, separator) < 1 << 16 else "<u4"


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text", kind: str = "<u2") -> DataFrame:
    """Writes a token file a task, under a temporary name and then renamed: part, nth, doc_id of each document."""
    fs, at = store(folder)
    fs.create_dir(at, recursive=True)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType()), T.StructField("doc_id", documents.schema[id_col].dataType)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, done = encoder(tokenizer, False), TaskContext.get().partitionId(), 0
        fs, at = store(folder)
        temporary = f"{at}/.{part:06d}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(temporary, compression=None) as f:
            for batch in slices(batches, "text", 2 << 20):
                first, ids = encode.encode(batch.column("text"))
                if len(ids) and int(ids.max()) >= 1 << 8 * int(kind[-1]):
                    raise ValueError(f"an id does not fit {kind[-1]} bytes")
                f.write(np.insert(ids.astype(kind), first[1:], separator).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(done, done + n)), batch.column("doc_id")], schema.names)
                done += n
        rename(fs, temporary, f"{at}/{part:06d}.tokens")

    return stored(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(write, schema), new_dir(documents.sparkSession, "numbers"))


def count_tokens(parts: DataFrame, folder: str, separator: int = SEPARATOR, block: int = BLOCK, kind: str = "<u2") -> DataFrame:
    """part, nth, n_tokens of every document in the token files of ``parts`` (part).  Executors look up the files' sizes."""
    spark = parts.sparkSession
    each = int(kind[-1])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = store(folder)
        for batch in batches:
            for part in batch.column("part").to_pylist():
                n = -(-fs.get_file_info(f"{at}/{part:06d}.tokens").size // block)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(n), pa.int32())], ["part", "block"])

    blocks = parts.mapInArrow(cut, "part int, block int").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = store(folder)
        for batch in batches:
            for part, number in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), strict=True):
                with fs.open_input_file(f"{at}/{part:06d}.tokens") as f:
                    ids = np.frombuffer(f.read_at(min(block, f.size() - number * block), number * block), kind)
                ends = np.flatnonzero(ids == separator) + number * (block // each)
                inner = np.diff(ends) - 1
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[0]) if len(ends) else None], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([inner], pa.list_(pa.int64()))], ["part", "block", "many", "first", "last", "inner"])

    found = stored(blocks.mapInArrow(scan, "part int, block int, many long, first long, last long, inner array<long>"), new_dir(spark, "blocks"))
    # Only three numbers a block go through the prefix scan; the lists of lengths stay where they were written.
    before = W.Window.partitionBy("part").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    prefix = found.select("part", "block", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"))
    placed = found.filter("many > 0").join(prefix, ["part", "block"])
    lengths = F.concat(F.array(F.col("first") - F.col("previous") - 1), F.col("inner"))
    return placed.select("part", "base", F.posexplode(lengths)).select("part", (F.col("base") + F.col("pos")).alias("nth"), F.col("col").alias("n_tokens"))


def token_counts(documents: DataFrame, tokenizer: str, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of every document, by way of token files."""
    kind = id_type(tokenizer, separator)
    numbers = write_tokens(documents, folder := new_dir(documents.sparkSession, "tokens"), tokenizer, separator, kind=kind)
    counts = count_tokens(numbers.select("part").distinct(), folder, separator, block, kind)
    return numbers.hint("merge").join(counts, ["part", "nth"]).select("doc_id", "n_tokens")
