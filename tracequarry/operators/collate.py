"""Padded batches of token lists: rows of like lengths meet in a batch, under a budget of tokens.

Rows are dealt by ranges of their width, so a task holds neighbouring widths and a common width is spread over tasks; there is no sort of the
whole table and no count of it.  A task fills one batch at a time and hands it on, so it holds no more than one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the label of a padded place, which a loss leaves out.
NO_LABEL = -100
#: Widths are multiples up to this many; beyond, steps double, so that padding to a width stays below an eighth of it.
PLAIN_STEPS = 16


def width_of(length: Column, multiple: int, least: int = 0) -> Column:
    """The width that a list of ``length`` is padded to: the next of a few, all multiples of ``multiple``, and ``least`` at least."""
    units = F.greatest(F.lit(1), F.ceil(F.greatest(length, F.lit(least)) / multiple)).cast("long")
    step = F.when(units <= PLAIN_STEPS, F.lit(1)).otherwise(F.pow(F.lit(2), F.length(F.bin(units - 1)) - 4)).cast("long")
    return (F.ceil(units / step) * step * multiple).cast("long")


def _filled(rows: list[tuple], width: int, pad: int) -> dict:
    n = len(rows)
    ids, mask, labels = np.full((n, width), pad, np.int64), np.zeros((n, width), np.int8), np.full((n, width), NO_LABEL, np.int64)
    for k, (_, own, wanted) in enumerate(rows):
        ids[k, : len(own)], mask[k, : len(own)], labels[k, : len(wanted)] = own, 1, wanted
    return {"input_ids": list(ids), "attention_mask": list(mask), "labels": list(labels)}


def collate(rows: DataFrame, *, id_col: str, ids_col: str, labels_col: str | None = None, budget: int = 16_384, multiple: int = 8, least: int = 0, pad: int = 0) -> DataFrame:
    """(batch, width, n, row_ids, input_ids, attention_mask, labels): each row of ``rows`` in exactly one batch of lists of one width.

    A batch has as many rows as fit ``budget`` tokens, padding included, and at least one, so a list beyond the budget is a batch of its own.  Null and empty
    lists are padded whole; without ``labels_col`` the ids are the labels; labels are cut or padded to the ids' length.  ``row_ids`` are text.
    """
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>")).cast("array<bigint>")
    labels = ids if labels_col is None else F.slice(F.coalesce(F.col(labels_col), F.array().cast("array<int>")).cast("array<bigint>"), F.lit(1), F.size(ids))
    plain = rows.select(F.col(id_col).cast("string").alias("id"), ids.alias("ids"), labels.alias("labels"), width_of(F.size(ids), multiple, least).alias("width"))
    by = [F.col("width"), F.xxhash64("id", F.monotonically_increasing_id())]
    dealt = plain.withColumn("_by", by[1]).repartitionByRange("width", "_by").sortWithinPartitions("width").drop("_by")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, width = TaskContext.get().partitionId(), 0, [], None

        def handed_on() -> pa.RecordBatch:
            made = _filled(held, width, pad)
            one = [[f"{part}-{number}"], [width], [len(held)], [[r[0] for r in held]], *([v] for v in made.values())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, schema.types)], schema=schema)

        for arrow in parts:
            for at, own, wanted, wide in zip(arrow["id"].to_pylist(), arrow["ids"], arrow["labels"], arrow["width"].to_pylist()):
                if held and (wide != width or (len(held) + 1) * wide > budget):
                    yield handed_on()
                    held, number = [], number + 1
                width = wide
                held.append((at, own.values.to_numpy(zero_copy_only=False), wanted.values.to_numpy(zero_copy_only=False)))
        if held:
            yield handed_on()

    matrix = pa.list_(pa.list_(pa.int64()))
    schema = pa.schema([("batch", pa.string()), ("width", pa.int64()), ("n", pa.int64()), ("row_ids", pa.list_(pa.string())), ("input_ids", matrix), ("attention_mask", pa.list_(pa.list_(pa.int8()))), ("labels", matrix)])
    ddl = "batch string, width bigint, n bigint, row_ids array<string>, input_ids array<array<bigint>>, attention_mask array<array<tinyint>>, labels array<array<bigint>>"
    return dealt.mapInArrow(batches, ddl)


def padding_report(batches: DataFrame, budget: int) -> DataFrame:
    """For each width the rows, the tokens, the padded places and the batches of more than one row that break the budget (none)."""
    tokens = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda s, row: s + F.aggregate(row, F.lit(0).cast("long"), lambda t, x: t + x))
    rows = batches.select("width", "n", tokens.alias("tokens"), ((F.col("n") > 1) & (F.col("n") * F.col("width") > budget)).alias("over"))
    found = rows.groupBy("width").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.count_if("over").alias("over_budget"))
    return found.select("width", "n", "tokens", (F.col("n") * F.col("width") - F.col("tokens")).alias("padding"), "over_budget")
