"""Tokens per document from flat token blocks without an index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oreflow.llm.common import map_texts, ragged
from oreflow.llm.tokens import Encoder
from oreflow.session import work_path

END = 65535
"""The end of a document: no id of the vocabulary, so no text holds it."""
BLOCK_TOKENS = 1 << 16


def write_tokens(docs: DataFrame, path: str, block_tokens: int = BLOCK_TOKENS, ranks: str | None = None) -> None:
    """Write ``docs`` (doc_id, text) as flat token streams below ``path``.

    Each task writes one stream: the 16-bit ids of its documents one after another, each closed by
    the end-of-document id, cut into blocks of ``block_tokens`` wherever that falls. ``kind=tokens``
    has (stream, block, tokens) and nothing else; ``kind=order`` has (stream, ordinal, doc_id), the names
    of a stream's documents in order.
    """

    def make():
        encode = Encoder(ranks)
        end = np.array([END], dtype="<u2").tobytes()
        state = {"rest": b"", "block": 0, "ordinal": 0}
        stream = TaskContext.get().partitionId()
        size = 2 * block_tokens

        def work(part: pa.RecordBatch | None) -> dict:
            out = [state["rest"]]
            ids = part.column("doc_id").to_pylist() if part else []
            for text in part.column("text").to_pylist() if part else []:
                out += [np.frombuffer(encode(text), dtype="<u4").astype("<u2").tobytes(), end]
            data = b"".join(out)
            stop = len(data) if part is None else len(data) // size * size
            blocks = [data[at : at + size] for at in range(0, stop, size)]
            state["rest"] = data[stop:]
            n = len(blocks) + len(ids)
            found = {
                "kind": ["tokens"] * len(blocks) + ["order"] * len(ids),
                "stream": [stream] * n,
                "place": [*range(state["block"], state["block"] + len(blocks)), *range(state["ordinal"], state["ordinal"] + len(ids))],
                "doc_id": [None] * len(blocks) + ids,
                "tokens": blocks + [None] * len(ids),
            }
            state["block"] += len(blocks)
            state["ordinal"] += len(ids)
            return found

        return work

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "kind string, stream int, place long, doc_id long, tokens binary"
    map_texts(rows, schema, make, last=True).write.partitionBy("kind").parquet(path)


def scan_blocks(blocks: DataFrame) -> DataFrame:
    """(stream, place, size, ends): per block its tokens and the places of the end ids in it."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sizes, found = [], []
                for tokens in part.column("tokens"):
                    ids = np.frombuffer(tokens.as_buffer(), dtype="<u2")
                    sizes.append(len(ids))
                    found.append(np.flatnonzero(ids == END).astype(np.int64))
                ends = ragged(np.concatenate(found), [len(f) for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("stream"), part.column("place"), pa.array(sizes, type=pa.int64()), ends],
                    names=["stream", "place", "size", "ends"],
                )

    return blocks.select("stream", "place", "tokens").mapInArrow(run, "stream int, place long, size long, ends array<long>")


def stitched(scanned: DataFrame) -> DataFrame:
    """(stream, ordinal, start, n_tokens) of every document, end id not counted.

    Prefix scans over a stream's blocks give each block its place in the stream, the number of documents
    that ended before it and where the last of them ended; a document over any number of blocks needs no more.
    """
    before = Window.partitionBy("stream").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    based = scanned.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
    last = F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1))
    based = based.withColumns(
        {"done": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)), "previous": F.coalesce(F.max(last).over(before), F.lit(-1))}
    )
    each = based.select("stream", "base", "done", "previous", "ends", F.posexplode("ends").alias("i", "at"))
    start = F.when(F.col("i") == 0, F.col("previous")).otherwise(F.col("base") + F.get("ends", F.col("i") - 1)) + 1
    return each.select(
        "stream",
        (F.col("done") + F.col("i")).alias("ordinal"),
        start.alias("start"),
        (F.col("base") + F.col("at") - start).alias("n_tokens"),
    )


def token_counts(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, ranks: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_tokens, and the stream and start of its ids.

    Null and empty texts have 0 tokens. Repeated rows and null ids are documents of their own. A document
    may span any number of blocks. Extra columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = work_path(spark, "tokens")
    write_tokens(docs, path, block_tokens, ranks)
    schema = "stream int, place long, doc_id long, tokens binary, kind string"
    flat = spark.read.schema(schema).parquet(path)
    found = stitched(scan_blocks(flat.filter("kind = 'tokens'")))
    names = flat.filter("kind = 'order'").select("stream", F.col("place").alias("ordinal"), "doc_id")
    return names.join(found, ["stream", "ordinal"]).select("doc_id", "n_tokens", "stream", "start")
