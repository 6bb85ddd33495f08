"""Token counts with the exact count at every prefix.

Null texts count as empty; empty texts have no tokens and an empty table; repeated rows give repeated
results; an empty frame gives an empty frame. Only the id and text columns are read, so further
columns of any name do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunk_bpe
from .common import map_arrow, text_or_empty


def prefix_token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, prefix_width and prefix_table.

    The table holds one signed step per character (1 or 4 bytes each, as prefix_width says), so that
    truncation and budget questions are answered from it by a running sum; see ``longest_prefix`` and
    ``tokens_before``. One narrow pass, no shuffle.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("prefix_width", T.IntegerType()),
            T.StructField("prefix_table", T.BinaryType()),
        ]
    )

    def count(batches):
        bpe = chunk_bpe.loaded(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                widths, tables, totals, sizes = [], [], [], []
                texts = part.column(1).to_pylist()
                for text, (width, steps) in zip(texts, bpe.prefix_tables(texts), strict=True):
                    widths.append(width)
                    tables.append(steps)
                    totals.append(int(np.frombuffer(steps, "i1" if width == 1 else "<i4").sum(dtype=np.int64)))
                    sizes.append(len(text.encode()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(widths, pa.int32()), pa.array(tables, pa.binary())],
                    names=[id_col, "n_bytes", "n_tokens", "prefix_width", "prefix_table"],
                )

    return map_arrow(docs.select(id_col, text_or_empty(text_col).alias("text")), count, schema)


def longest_prefix(budget: int, width: str = "prefix_width", table: str = "prefix_table") -> Column:
    """Most leading characters that fit in ``budget`` tokens, from stored tables alone."""

    @F.pandas_udf("long")
    def fit(w, t):
        import pandas as pd

        return pd.Series([chunk_bpe.longest_prefix(a, b, budget) for a, b in zip(w, t, strict=True)])

    return fit(F.col(width), F.col(table))


def tokens_before(prefix: Column, width: str = "prefix_width", table: str = "prefix_table") -> Column:
    """Tokens of the text's first ``prefix`` characters, from stored tables alone."""

    @F.pandas_udf("long")
    def look(w, t, p):
        import pandas as pd

        return pd.Series([chunk_bpe.count_at(a, b, c) for a, b, c in zip(w, t, p, strict=True)])

    return look(F.col(width), F.col(table), prefix)
