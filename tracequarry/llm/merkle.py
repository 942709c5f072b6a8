"""Merkle manifest of a dataset: a leaf a row, a tree a group, a tree over the groups, and a proof for every row.

Leaves get their places in a group by a range sort, so a group is never in one task.  Aligned blocks of ``FANOUT ** HEIGHT``
leaves are contiguous matrices of 64 hexadecimal digits a row: a level is reshaped by the fanout and its rows are hashed, and a
node's siblings are found from its place alone.  Block roots are the leaves of the next, far smaller round.  Proofs come down the same way: the
siblings above a block are joined once to the block, not to its leaves.  Verification is native and needs a leaf, its place and its proof only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FANOUT = 3
#: Levels that a block of leaves spans: 243 leaves.
HEIGHT = 5
DIGITS = 64


def leaf_digest(fields: Iterable[Column]) -> Column:
    """Digest of a row: for each field ``-`` if null, else its UTF-8 length, a colon and the value."""
    parts = []
    for c in fields:
        value = c.cast("string")
        parts.append(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def climb(level: np.ndarray, fanout: int, most: int | None = None) -> list[np.ndarray]:
    """Levels over a matrix of digests (nodes x 64 letters), itself first: up to one node, or ``most`` levels whatever is left."""
    levels = [level]
    while (len(levels[-1]) > 1) if most is None else (len(levels) <= most):
        below = levels[-1]
        whole = len(below) // fanout
        runs = [bytes(run) for run in below[: whole * fanout].reshape(whole, fanout * DIGITS)]
        if whole * fanout < len(below):
            runs.append(below[whole * fanout :].tobytes())
        above = b"".join(hashlib.sha256(run).hexdigest().encode() for run in runs)
        levels.append(np.frombuffer(above, np.uint8).reshape(len(runs), DIGITS))
    return levels


def siblings(levels: list[np.ndarray], fanout: int) -> list[bytes]:
    """For each node of the first level its siblings on the way up, level by level, left to right."""
    place, found = np.arange(len(levels[0])), []
    for level in levels[:-1]:
        run = place // fanout * fanout
        for step in range(fanout):
            at = run + step
            there = (at < len(level)) & (at != place)
            found.append(np.where(there[:, None], level[np.minimum(at, len(level) - 1)], 0).astype(np.uint8))
        place //= fanout
    if not found:
        return [b""] * len(levels[0])
    return [row.tobytes().replace(b"\0", b"") for row in np.concatenate(found, axis=1)]


def _digests(table: pa.Table, column: str) -> np.ndarray:
    joined = b"".join(table[column].cast(pa.binary()).to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(len(table), DIGITS)


def _placed(nodes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``nodes`` as a written table with their place in the group, the group's size and the block: (.., _at, _n, _block).

    Rows are dealt by ranges of (group, order, row), so equal keys do not meet in one task; the places follow from the sums of the partitions.
    """
    nodes = nodes.withColumn("_row", F.monotonically_increasing_id())
    by = [F.col(key), *(F.col(c).asc_nulls_first() for c in order), F.col("_row")]
    dealt = nodes.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")
    dealt = cut(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_line")))
    parts = dealt.groupBy(key, "_part").agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    ahead = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(key, "_part", (F.coalesce(F.sum("_rows").over(ahead), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(Window.partitionBy(key)).alias("_n"))
    found = dealt.join(parts, [key, "_part"]).withColumn("_at", F.col("_line") + F.col("_shift"))
    return found.drop("_part", "_line", "_shift")


def _levels(table: pa.Table, fanout: int, height: int) -> list[np.ndarray]:
    whole = table["_n"][0].as_py() <= fanout**height
    return climb(_digests(table, "_digest"), fanout, None if whole else height)


def _roots(nodes: DataFrame, key: str, fanout: int, height: int) -> DataFrame:
    """(key, _at, _n, _digest): the block roots of ``nodes``, placed as the nodes of the next round."""
    size = fanout**height

    def reduced(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        root = _levels(table, fanout, height)[-1].tobytes().decode()
        n = table["_n"][0].as_py()
        return pa.table({key: table[key].slice(0, 1), "_at": [table["_at"][0].as_py() // size], "_n": [-(-n // size)], "_digest": [root]}, schema=schema)

    schema = pa.schema([(key, pa.string()), ("_at", pa.int64()), ("_n", pa.int64()), ("_digest", pa.string())])
    blocks = nodes.select(key, "_at", "_n", "_digest", F.expr(f"_at div {size}").alias("_block"))
    return blocks.groupBy(key, "_block").applyInArrow(reduced, f"{key} string, _at bigint, _n bigint, _digest string")


def _proofs(nodes: DataFrame, above: DataFrame, key: str, kept: list[str], fanout: int, height: int) -> DataFrame:
    """``nodes`` (the columns ``kept``) with ``_proof``: their siblings within their block, then those of the block in ``above``."""
    size = fanout**height
    fields = [f for f in nodes.schema.fields if f.name in kept]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _proof string, _root string"

    def told(table: pa.Table, block: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        rest, root = block["_proof"][0].as_py(), block["_root"][0].as_py()
        own = [x.decode() + rest for x in siblings(_levels(table, fanout, height), fanout)]
        out = table.select([f.name for f in fields])
        return out.append_column("_proof", pa.array(own, pa.string())).append_column("_root", pa.array([root] * len(table), pa.string()))

    blocks = nodes.withColumn("_block", F.expr(f"_at div {size}")).groupBy(key, "_block")
    tops = above.select(key, F.col("_at").alias("_block"), "_proof", "_root").groupBy(key, "_block")
    return blocks.cogroup(tops).applyInArrow(told, ddl)


def _trees(nodes: DataFrame, key: str, fanout: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The rounds from ``nodes`` up to one node a group, and that last one."""
    rounds = [nodes]
    while True:
        rounds.append(cut(_roots(rounds[-1], key, fanout, height)))
        if not rounds[-1].where("_n > 1").take(1):
            return rounds[:-1], rounds[-1]


def manifest(leaves: DataFrame, *, digest_col: str, group_col: str, order_col: str, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """``leaves`` with its subroot, root, slot, n_leaves, group_slot, n_groups and proof (64 digits a sibling, from the leaf up to the root).

    A group's leaves ascend by ``order_col`` (null first; ties by digest, so copies of a row are interchangeable), groups by
    their name's UTF-8 bytes, null first.  Runs of ``fanout`` become one node until one is left, so a lone leaf is its own subroot and the
    last run may hold one node.  Columns of ``leaves`` stay; names that the result adds, or that begin with ``_``, are refused.
    An empty table gives no rows.  ``leaves`` is read twice (places need a sample), so it should be a written table.
    """
    own = {"subroot", "root", "slot", "n_leaves", "group_slot", "n_groups", "proof"}
    if clash := [c for c in leaves.columns if c.lower() in own or c.startswith("_")]:
        raise ValueError(f"rename these columns first: {clash}")
    # Null becomes the empty name, which sorts first; all others get a letter in front, so that they stay in order and none is empty.
    named = leaves.withColumn("_key", F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(group_col).cast("string"))))
    nodes = _placed(named.withColumn("_digest", F.col(digest_col)), "_key", [order_col, "_digest"])
    rounds, tops = _trees(nodes, "_key", fanout, height)
    groups = tops.select(F.lit("").alias("_all"), F.col("_key").alias("_name"), "_digest")
    over, root = _trees(_placed(groups, "_all", ["_name"]), "_all", fanout, height)
    above = root.select("_all", "_at", F.lit("").alias("_proof"), F.col("_digest").alias("_root"))
    for k, level in reversed(list(enumerate(over))):
        above = cut(_proofs(level, above, "_all", ["_all", "_at"] + ["_n", "_name", "_digest"] * (not k), fanout, height))
    # From here on a block's top carries its group's subroot, place and the groups' number along with the root.
    facts = F.to_json(F.struct("_root", F.col("_digest").alias("_subroot"), "_at", "_n"))
    above = above.select(F.col("_name").alias("_key"), F.lit(0).cast("long").alias("_at"), "_proof", facts.alias("_root"))
    kept = [c for c in nodes.columns if c not in ("_key", "_digest")]
    for k, level in reversed(list(enumerate(rounds))):
        above = _proofs(level, above, "_key", ["_key", "_at"] if k else kept, fanout, height)
        above = cut(above) if k else above
    told = F.from_json("_root", "_root string, _subroot string, _at bigint, _n bigint")
    out = above.withColumn("_told", told)
    return out.select(
        *leaves.columns, F.col("_told._subroot").alias("subroot"), F.col("_told._root").alias("root"), F.col("_at").alias("slot"),
        F.col("_n").alias("n_leaves"), F.col("_told._at").alias("group_slot"), F.col("_told._n").alias("n_groups"), F.col("_proof").alias("proof"),
    )


def folded_root(digest: Column, proof: Column, slot: Column, n_leaves: Column, group_slot: Column, n_groups: Column, fanout: int = FANOUT) -> Column:
    """The root that follows from a leaf's digest, its place and the siblings on its way: native, no table is read."""
    powers = [p for p in (fanout**k for k in range(64)) if p < 1 << 62]

    def up(state: Column, at: Column, n: Column) -> Column:
        """``state`` (digest, letters of the proof read) folded over the levels of a tree of ``n`` nodes; ``at`` is the place of the first."""
        below = F.array(*(F.lit(p) for p in powers))
        steps = F.filter(below, lambda p: p < n)

        def step(s: Column, p: Column) -> Column:
            place, nodes = F.floor(at / p), F.ceil(n / p)
            own = F.pmod(place, F.lit(fanout)).cast("int")
            run = F.least(F.lit(fanout), nodes - place + own).cast("int")
            left = proof.substr(s["read"] + 1, own * DIGITS)
            right = proof.substr(s["read"] + own * DIGITS + 1, (run - own - 1) * DIGITS)
            return F.struct(F.sha2(F.concat(left, s["digest"], right), 256).alias("digest"), (s["read"] + (run - 1) * DIGITS).alias("read"))

        return F.aggregate(steps, state, step)

    start = F.struct(digest.alias("digest"), F.lit(0).alias("read"))
    return up(up(start, slot, n_leaves), group_slot, n_groups)["digest"]


def tamper_audit(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, with half of the rows altered after the manifest was made.

    Altered rows are those whose id, as decimal text, has an even CRC-32; their texts lose all line feeds, and nothing else.  So a
    row stays verified if its text has none, or is null, or its id is odd in that sense or null.  Rows with equal ids are leaves of their own;
    other columns are not read.
    """
    altered = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(2)) == 0
    cut_text = F.when(altered, F.translate(F.col(text_col), "\n", "")).otherwise(F.col(text_col))
    now = leaf_digest(cut_text if c == text_col else F.col(c) for c in fields)
    leaf = leaf_digest(F.col(c) for c in fields)
    leaves = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf.alias("leaf"), now.alias("now"))
    made = manifest(cut(leaves), digest_col="leaf", group_col="grp", order_col="id")
    folded = folded_root(F.col("now"), F.col("proof"), F.col("slot"), F.col("n_leaves"), F.col("group_slot"), F.col("n_groups"))
    out = made.select(F.col("id").alias(id_col), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
