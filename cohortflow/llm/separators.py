"""Token counts of flat, unindexed token files: a vectorised search for end-of-document ids, stitched by a prefix scan.

A flat file is a sequence of blocks of two-byte ids, cut without regard to documents: rows (file, block, payload).
``flat_files`` writes documents that way, ``blocks_of`` reads files of raw ids (any store that Spark reads; a file is one
read, so files should be of bounded size, as such shards are). Every block is searched on its own; a prefix scan over the
blocks' counts and lengths (inside groups of ``GROUP`` blocks, then over groups) gives each block its first document's number
and where that document began, so documents that cross blocks are whole and no task sees more than a block at a time.

``flat_files`` encodes an added token in a text as ordinary characters: its id is the end id, so it would end the document.
A null or empty text is its end id alone. Two ends in a row are an empty document of one id. Ids after a file's last end are
a document that is not ``ended``. Empty files and tables give no documents. Repeated rows are counted each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortflow.session import written

from .textkit import Hasher, SpanTokens, arrow_batch, byte_bpe, token_ids

END, BLOCK, GROUP = 50256, 1 << 16, 4096
BLOCKS = "file int, block long, payload binary, doc_id long, doc_no long"


def flat_files(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks, manifest): one flat file for each partition, and (file, doc_no, doc_id), which the scan does not use."""

    def run(batches):
        from pyspark import TaskContext

        file, at, no, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        hasher, spans = Hasher(), SpanTokens(byte_bpe(vocabulary))

        def cut(last: bool):
            nonlocal at, held, size
            flat = np.concatenate(held) if held else np.zeros(0, "<u2")
            whole = len(flat) if last else len(flat) // block * block
            payload = [flat[i:i + block].tobytes() for i in range(0, whole, block)]
            n = len(payload)
            out = arrow_batch(BLOCKS, [[file] * n, range(at, at + n), payload, [None] * n, [None] * n])
            at, held, size = at + n, [flat[whole:]], len(flat) - whole
            return out

        for batch in batches:
            ids = batch.column(0)
            n = batch.num_rows
            yield arrow_batch(BLOCKS, [[file] * n, [None] * n, [None] * n, ids, range(no, no + n)])
            no += n
            for x in token_ids(batch.column(1).to_pylist(), spans, hasher):
                held.append(np.append(x, end).astype("<u2"))
                size += len(x) + 1
                if size >= 16 * block:
                    yield cut(False)
        yield cut(True)

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    both = written(texts.mapInArrow(run, BLOCKS), "flat")
    return both.where("payload IS NOT NULL").select("file", "block", "payload"), both.where("payload IS NULL").select("file", "doc_no", "doc_id")


def blocks_of(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Blocks of raw files of little-endian two-byte ids under ``path``; ``file`` is the file's path."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_buffer()
                n = -(-raw.size // (2 * block))
                yield arrow_batch("file string, block long, payload binary", [[file] * n, range(n), [raw[i * 2 * block:(i + 1) * 2 * block].to_pybytes() for i in range(n)]])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, payload binary")


def searched(blocks: DataFrame, end: int = END) -> DataFrame:
    """(file, block, n_ids, ends): places of the end ids in each block."""
    kind = blocks.schema["file"].dataType.simpleString().replace("bigint", "long")
    schema = f"file {kind}, block long, n_ids long, ends array<int>"

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(2)]
            yield arrow_batch(schema, [batch.column(0), batch.column(1), [len(x) for x in found], [np.flatnonzero(x == end).astype(np.int32) for x in found]])

    return blocks.select("file", "block", "payload").mapInArrow(run, schema)


def documents(found: DataFrame, group: int = GROUP) -> DataFrame:
    """(file, doc_no, start, n_tokens, ended) from searched blocks; n_tokens counts the end id. ``found`` is read three times."""
    s = found.select("file", "block", (F.col("block") / group).cast("long").alias("group"), "n_ids", F.size("ends").alias("n_ends"), F.try_element_at("ends", F.lit(-1)).alias("last"), "ends")
    before = lambda *by: Window.partitionBy("file", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    # Inside a group: ids and ends before each block, and where the open document began, as an offset in the group.
    inside = s.withColumns({"ids_in": zero(F.sum("n_ids").over(before("group", "block"))), "ends_in": zero(F.sum("n_ends").over(before("group", "block")))})
    inside = inside.withColumn("open_in", F.max(F.col("ids_in") + F.col("last") + 1).over(before("group", "block")))
    groups = inside.groupBy("file", "group").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_ends").alias("n_ends"), F.max(F.col("ids_in") + F.col("last") + 1).alias("open"))
    groups = groups.withColumns({"ids_before": zero(F.sum("n_ids").over(before("group"))), "ends_before": zero(F.sum("n_ends").over(before("group")))})
    groups = groups.withColumn("open_before", zero(F.max(F.col("ids_before") + F.col("open")).over(before("group"))))
    at = inside.join(groups.select("file", "group", "ids_before", "ends_before", "open_before"), ["file", "group"])
    at = at.select("file", (F.col("ids_before") + F.col("ids_in")).alias("from"), (F.col("ends_before") + F.col("ends_in")).alias("doc"),
                   F.coalesce(F.col("ids_before") + F.col("open_in"), "open_before").alias("open"), "ends")
    each = at.select("file", "from", "doc", "open", F.posexplode("ends").alias("i", "end"), F.col("ends"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("from") + F.element_at("ends", F.greatest("i", F.lit(1))) + 1)
    whole = each.select("file", (F.col("doc") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("from") + F.col("end") + 1 - start).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = groups.groupBy("file").agg(F.sum("n_ids").alias("n"), F.sum("n_ends").alias("doc_no"), zero(F.max(F.col("ids_before") + F.col("open"))).alias("start"))
    rest = rest.where("n > start").select("file", "doc_no", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)
