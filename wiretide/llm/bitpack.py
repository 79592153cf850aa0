"""Token-id files of fixed-width bits.

Layout, little-endian: 8 bytes magic; blocks of BLOCK ids, each id in ``bits`` bits, lowest bit
first; then per document its id (int64) and number of token ids (int64); then the offset of every
block (int64); then a footer of six int64: bits, ids, documents, blocks, place of the document
table, place of the block table.  A block is whole bytes, so any id is found from its block's
offset, and a block unpacks in one numpy expression.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiretide.llm.common import by_bytes, give_back, materialize, scratch_dir, shuffle_partitions, table
from wiretide.llm.tokens import PartEncoder, token_ids

MAGIC = b"WTIDPAK1"
BLOCK = 4096
_FOOT = 6 * 8
#: Bytes of text that a task encodes at once; two workers share an executor with the rows being sorted.
SLICE_BYTES = 2 << 20
#: Stands for a null document id in a file.
NULL_ID = -(1 << 63)


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    if bits == 32:
        return np.frombuffer(data, "<u4", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Writer:
    """Writes one file, block by block; the file takes its name only when it is complete."""

    def __init__(self, uri: str, bits: int):
        self.fs, self.path = _filesystem(uri)
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.tmp, self.bits = self.path + f".{uuid.uuid4().hex}.part", bits
        self.out = self.fs.open_output_stream(self.tmp)
        self.out.write(MAGIC)
        self.at, self.n = len(MAGIC), 0
        self.rest, self.held = [np.zeros(0, np.uint32)], 0
        self.docs: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.blocks: list[int] = []

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.lengths.append(lengths)
        self.rest.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        if self.held >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            raw = pack_bits(ids[i : min(i + BLOCK, whole)], self.bits)
            self.blocks.append(self.at)
            self.out.write(raw)
            self.at += len(raw)
        self.rest, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        docs = np.concatenate([np.zeros(0, np.int64), *self.docs])
        lengths = np.concatenate([np.zeros(0, np.int64), *self.lengths])
        for x in (docs, lengths, np.array(self.blocks, np.int64), np.array([self.bits, self.n, len(docs), len(self.blocks), self.at, self.at + 16 * len(docs)], np.int64)):
            self.out.write(x.astype("<i8").tobytes())
        self.out.close()
        self.fs.move(self.tmp, self.path)


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a token-id file: {uri}")
        self.bits, self.n_ids, n_docs, n_blocks, docs_at, blocks_at = np.frombuffer(self.file.read_at(_FOOT, size - _FOOT), "<i8").tolist()
        self.doc_ids = np.frombuffer(self.file.read_at(8 * n_docs, docs_at), "<i8")
        self.lengths = np.frombuffer(self.file.read_at(8 * n_docs, docs_at + 8 * n_docs), "<i8")
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blocks = np.frombuffer(self.file.read_at(8 * n_blocks, blocks_at), "<i8")

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids at [start, end) of the file; reads only the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, (end - 1) // BLOCK
        upto = min((b + 1) * BLOCK, self.n_ids)
        n = upto - a * BLOCK
        raw = self.file.read_at((n * self.bits + 7) // 8, int(self.blocks[a]))
        return unpack_bits(raw, self.bits, n)[start - a * BLOCK : end - a * BLOCK]


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Encodes whole texts and writes one file per range of ids; returns ``(path, first_id, n_docs, n_ids, start)``.

    Texts are range-partitioned and sorted by id before they are encoded, so files in order of
    ``start`` hold the documents in ascending id.  Null text is empty (only the end id).  Rows
    with equal ids stay together, ordered by text.  A null id comes
    first and is kept in files as NULL_ID.  A task that is retried writes a new file; the
    manifest names only files of tasks that ended.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, first, total = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if writer is None:
                size = PartEncoder.get(tokenizer_path, True).tokenizer.get_vocab_size(with_added_tokens=True)
                path = f"{folder}/ids-{uuid.uuid4().hex}.bin"
                writer, first = Writer(path, bits_for(max(size, (end_id or 0) + 1))), int(doc[0])
            for part in by_bytes(batch, 1, SLICE_BYTES):
                for at, ids, offs in token_ids(part.column(1), tokenizer_path):
                    n = np.diff(offs)
                    if end_id is not None:
                        ids = np.insert(ids, offs[1:], np.uint32(end_id))
                        n = n + 1
                    writer.add(doc[at : at + len(n)], n, ids)
                    total += len(n)
                doc = doc[part.num_rows :]
            give_back()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first], pa.int64()), pa.array([total], pa.int64()), pa.array([writer.n], pa.int64())], ["path", "first_id", "n_docs", "n_ids"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(partitions or shuffle_partitions(spark), "id").sortWithinPartitions("id", "text")
    files = materialize(dealt.mapInArrow(run, "path string, first_id bigint, n_docs bigint, n_ids bigint"), "manifest")
    # one row a file: the running total of ids is a window over the manifest alone
    before = Window.orderBy("first_id", "path").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of each document in the files of a manifest."""
    spark = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = Reader(path)
                for a, b in _runs(r.lengths):
                    lo, hi = int(r.starts[a]), int(r.starts[b - 1] + r.lengths[b - 1])
                    raw = memoryview(r.ids(lo, hi).astype("<u4")).cast("B")
                    at = (r.starts[a:b] - lo) * 4
                    crc = [zlib.crc32(raw[s : s + 4 * n]) for s, n in zip(at.tolist(), r.lengths[a:b].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[a:b]), pa.array(r.starts[a:b] + base), pa.array(r.lengths[a:b]), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("path", "start").repartition(shuffle_partitions(spark), "path")
    return files.mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumn("id", F.nullif("id", F.lit(NULL_ID)))


def _runs(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about a million ids."""
    end = np.cumsum(lengths)
    a = 0
    while a < len(end):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + (1 << 20), "right")))
        yield a, b
        a = b


def op10_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/token-files-{uuid.uuid4().hex[:12]}"
    files = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_token_files(files).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
