"""Best-fit packing of token sequences with a bounded number of open bins.

A document is its ids plus a closing id; documents longer than the capacity are cut, others stay
whole. Tokenising is one narrow pass that leaves a few numbers per piece; only those are shuffled,
to packing tasks whose number grows with the input, each of which packs its pieces online: a piece
goes to the open bin with the least free space that still holds it, else to a new bin, and when all
bins are open the fullest closes first. Null texts count as empty (just the closing id), repeated
rows are packed as often as they occur, an empty frame gives an empty frame.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunk_bpe
from .common import map_arrow, n_slices, text_or_empty

#: Input partitions whose pieces one packing task takes; at 128 MB each, about 1 GB of text.
SLICES_PER_PACK = 8


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32. Cuts only documents longer than ``capacity``."""
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    end, step = int(end_id).to_bytes(4, "little"), 4 * capacity

    def cut(batches):
        bpe = chunk_bpe.loaded(vocabulary)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, own in enumerate(bpe.all_ids(map(str, batch.column(1)))):
                ids = memoryview(own + end)
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=schema.fieldNames(),
            )

    return map_arrow(docs.select(id_col, text_or_empty(text_col).alias("text")), cut, schema)


class OpenBins:
    """At most ``limit`` open bins; bit f of ``free`` is set while some open bin has f tokens free."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free, self.count, self.made = 0, 0, 0
        self.at: dict[int, list[int]] = {}

    def _push(self, space: int, bin_no: int) -> None:
        if space:
            self.at.setdefault(space, []).append(bin_no)
            self.free |= 1 << space
            self.count += 1

    def _pop(self, space: int) -> int:
        bins = self.at[space]
        bin_no = bins.pop()
        if not bins:
            self.free &= ~(1 << space)
        self.count -= 1
        return bin_no

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1..capacity tokens."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1  # the least space that holds it
            bin_no = self._pop(space)
        else:
            if self.count == self.limit:
                self._pop((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, bin_no = self.capacity, self.made
            self.made += 1
        self._push(space - length, bin_no)
        return bin_no, self.capacity - space


def pack_best_fit(pieces: DataFrame, capacity: int, open_bins: int = 512, id_col: str = "doc_id", packs: int | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``packs``: packing tasks, by default one per 8 input partitions."""
    packs = packs or max(1, -(-n_slices(pieces) // SLICES_PER_PACK))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(batches):
        from pyspark import TaskContext

        base, bins = TaskContext.get().partitionId() << 40, OpenBins(capacity, open_bins)
        for batch in batches:
            seqs, offsets = [], []
            for length in batch.column(batch.schema.get_field_index("length")).to_pylist():
                seq, offset = bins.place(length)
                seqs.append(base + seq)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64())], names=schema.fieldNames())

    dealt = pieces.repartition(packs, F.xxhash64(F.col(id_col), F.lit(7))).sortWithinPartitions(F.xxhash64(F.col(id_col)), "piece", "start")
    return map_arrow(dealt, pack, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, open_bins: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    pieces = token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col)
    return pack_best_fit(pieces, capacity, open_bins, id_col, packs=max(1, -(-n_slices(docs) // SLICES_PER_PACK)))
