"""Best-fit packing: pieces of documents into sequences under several capacities at once.

A sequence has residual tokens, residual pieces and residual attention cost (sum of squared
lengths).  Pieces come longest first; among the open sequences that hold a piece under every
constraint, the one whose weighted residual norm after placement is smallest takes it.
Shards are packed independently, so a shard costs one partly filled sequence at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretide.llm.common import give_back, materialize, table, tidied
from wiretide.llm.tokens import token_ids

#: Pieces of one shard, on average.
SHARD_PIECES = 16_384


def document_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, max_tokens: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: each document's ids and the end id, cut only where longer than max_tokens.

    Null and empty texts are the end id alone.  Texts of any length are encoded whole.  Null ids
    and repeated rows give pieces like others; an empty table gives none.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ids, offs in token_ids(batch.column(1), tokenizer_path):
                ids = np.insert(ids, offs[1:], np.uint32(end_id)).astype("<u4")
                n = np.diff(offs) + 1
                first = np.cumsum(n) - n
                pieces = -(-n // max_tokens)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * max_tokens
                length = np.minimum(n[doc] - start, max_tokens)
                raw, where = memoryview(ids).cast("B"), (first[doc] + start) * 4
                crc = [zlib.crc32(raw[s : s + 4 * k]) for s, k in zip(where.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + at)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidied(run), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, max_tokens: int, max_pieces: int, max_cost: float, weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths must be in descending order, and each must fit an empty bin."""
    n = len(lengths)
    if n and (lengths[0] > max_tokens or float(lengths[0]) ** 2 > max_cost or max_pieces < 1):
        raise ValueError("a piece exceeds a capacity of an empty bin")
    cap = np.array([max_tokens, max_pieces, max_cost], float)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # bins with the same residuals are interchangeable: one state, a stack of its bins
    state: dict[tuple[int, int, int], list[int]] = {}
    keys = np.zeros((0, 3))
    names: list[tuple[int, int, int]] = []
    used = 0
    w = np.array(weights) / cap
    dead = 0
    for i, size in enumerate(lengths.tolist()):
        need = np.array([size, 1, float(size) * size])
        pick = -1
        if len(names):
            left = keys - need
            ok = (left >= 0).all(1)
            if ok.any():
                score = ((left * w) ** 2).sum(1)
                score[~ok] = np.inf
                pick = int(score.argmin())
        if pick >= 0:
            old = names[pick]
            b = state[old].pop()
            if not state[old]:
                del state[old]
                keys[pick] = -1.0
                dead += 1
        else:
            old, b = (max_tokens, max_pieces, int(max_cost)), used
            used += 1
        bins[i], offsets[i] = b, max_tokens - old[0]
        new = (old[0] - size, old[1] - 1, int(old[2] - size * size))
        if new[0] > 0 and new[1] > 0:
            if new in state:
                state[new].append(b)
            else:
                state[new] = [b]
                names.append(new)
                if len(names) > len(keys):
                    keys = np.concatenate([keys[: len(names) - 1], np.full((max(64, len(keys)), 3), -1.0)])
                keys[len(names) - 1] = new
        if dead > 256 and dead > len(state):
            names = [k for k in names if k in state]
            names = list(dict.fromkeys(names))
            keys, dead = np.array(names, float).reshape(-1, 3), 0
    return bins, offsets


def pack_pieces(pieces: DataFrame, max_tokens: int = 4096, max_pieces: int | None = None, max_cost: float | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces ``(id, piece, start, length, ids_crc32)``.

    Every piece is placed once; offsets in a sequence are gapless from 0.  Without max_pieces or
    max_cost those capacities never bind (as in op4 and the pipeline, whose task bounds tokens
    only) and act through the weights of the norm alone.  Ties go to the smaller id, piece and
    checksum.  A piece longer than max_tokens,
    or costlier than max_cost, can't be placed and is an error.  Null ids and repeated rows are
    pieces like others; an empty table gives none.
    """
    pieces = materialize(pieces, "pieces")
    shards = max(1, -(-pieces.count() // SHARD_PIECES))
    top_pieces = max_pieces or max_tokens
    top_cost = max_cost or float(max_tokens) ** 2
    # the written table is fixed, so a row's place in it may salt repeated rows
    shard = F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).alias("shard")
    if not pieces.where((F.col("length") > max_tokens) | (F.col("length") * F.col("length") > top_cost)).isEmpty():
        raise ValueError("a piece exceeds a capacity of an empty sequence")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        b, o = best_fit(df["length"].to_numpy(), max_tokens, top_pieces, top_cost)
        df["sequence_id"] = df.pop("shard").astype("int64") * (1 << 32) + b
        df["offset"] = o
        give_back()
        return df

    out = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return pieces.select("*", shard).repartition(shards, "shard").groupBy("shard").applyInPandas(run, f"{out}, sequence_id bigint, offset bigint")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = document_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, 4096)
    out = pack_pieces(pieces, 4096)
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
