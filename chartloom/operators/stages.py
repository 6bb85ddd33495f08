"""Batched model stages: prompt column -> pluggable completer -> parsed column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A list of prompts to a list of replies, run inside tasks.
Completer = Callable[[list[str]], list[str]]


def complete(df: DataFrame, prompt: str, completer: Completer, out: str = "reply", batch: int = 64, accept: Callable[[str], bool] | None = None, tries: int = 10) -> DataFrame:
    """``df`` with the replies to its prompts; replies that ``accept`` refuses are asked for again, at most ``tries`` times."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    at = df.columns.index(prompt)

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, batch):
                part = b.slice(start, batch)
                prompts = [p or "" for p in part.column(at).to_pylist()]
                replies = completer(prompts)
                for _ in range(tries - 1 if accept else 0):
                    bad = [i for i, r in enumerate(replies) if not accept(r)]
                    if not bad:
                        break
                    for i, r in zip(bad, completer([prompts[i] for i in bad]), strict=True):
                        replies[i] = r
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(replies, pa.string())], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def per_group(df: DataFrame, row: str, groups: str, prompt: Callable[[Column], Column], completer: Completer, parse: Callable[[Column], Column], out: str) -> DataFrame:
    """One request for each item of an array column; parsed replies come back as an array in the items' order."""
    items = df.select(row, F.posexplode(groups).alias("_pos", "_item")).withColumn("_prompt", prompt(F.col("_item")))
    replies = complete(items.select(row, "_pos", "_prompt"), "_prompt", completer, "_reply")
    lists = replies.select(row, "_pos", parse(F.col("_reply")).alias("_v")).groupBy(row).agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_v"))), lambda x: x["_v"]).alias(out))
    return df.join(lists, row, "left")


def run_stages(df: DataFrame, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Apply named stages in order (analyse, locate, verify, assign)."""
    for _, stage in stages:
        df = stage(df)
    return df
