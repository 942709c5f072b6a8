"""Padded batches: every row once, the padding that it says, budgets held."""

import random

import numpy as np
from pyspark.sql import functions as F

from tracequarry.operators import collate


def brute_width(length, multiple, least=0):
    units = max(1, -(-max(length, least) // multiple))
    step = 1 if units <= 16 else 2 ** ((units - 1).bit_length() - 4)
    return -(-units // step) * step * multiple


def test_widths(spark):
    df = spark.range(0, 5000, 7).select(F.col("id").cast("int").alias("n"))
    for multiple, least in ((8, 0), (1, 0), (64, 300)):
        got = df.select("n", collate.width_of(F.col("n"), multiple, least).alias("w")).collect()
        assert all(r.w == brute_width(r.n, multiple, least) for r in got)
        assert all(r.w >= max(r.n, least) and r.w % multiple == 0 and r.w - max(r.n, least) <= max(multiple, r.w / 8) for r in got)


def test_batches(spark):
    rng = random.Random(2)
    lists = {i: [rng.randrange(1, 99) for _ in range(rng.choice([0, 3, 3, 3, 9, 40, 200]))] for i in range(500)}
    lists[900], lists[901] = list(range(1, 3000)), None
    rows = [(i, v, [x + 1 for x in v or []][: len(v or []) // 2], "extra") for i, v in lists.items()]
    df = spark.createDataFrame(rows, "id long, ids array<int>, marks array<int>, width string").repartition(3)
    got = collate.collate(df, id_col="id", ids_col="ids", labels_col="marks", budget=512, multiple=8, pad=7).collect()
    seen = {}
    for b in got:
        assert b.n == len(b.row_ids) == len(b.input_ids) and (b.n == 1 or b.n * b.width <= 512)
        for at, ids, mask, labels in zip(b.row_ids, b.input_ids, b.attention_mask, b.labels):
            own = lists[int(at)] or []
            assert int(at) not in seen and b.width == brute_width(len(own), 8) == len(ids) == len(mask) == len(labels)
            assert ids == own + [7] * (b.width - len(own)) and mask == [1] * len(own) + [0] * (b.width - len(own))
            assert labels == [x + 1 for x in own][: len(own) // 2] + [collate.NO_LABEL] * (b.width - len(own) // 2)
            seen[int(at)] = b.batch
    assert set(seen) == set(lists) and len({b.batch for b in got}) == len(got)
    # Batches are filled: a task leaves one open batch a width at most.
    assert len(got) <= sum(-(-n // max(1, 512 // w)) for w, n in zip(*np.unique([brute_width(len(v or []), 8) for v in lists.values()], return_counts=True))) + 4 * 8
    report = collate.padding_report(collate.collate(df, id_col="id", ids_col="ids", budget=512), 512)
    assert report.agg(F.sum("n"), F.sum("tokens"), F.sum("over_budget")).first()[:] == (len(lists), sum(len(v or []) for v in lists.values()), 0)
    assert collate.collate(df.limit(0), id_col="id", ids_col="ids").count() == 0
