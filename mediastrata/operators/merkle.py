"""Merkle trees over chunk hashes: roots, proofs, and their verification.

A parent is the hash of its children's bytes, left then right; the last node of an odd level moves up unchanged; the root of no
leaves is 32 zero bytes. A track whose hashes fit a row folds inside it, as deep as it is; tracks of any length fold in blocks of
2^BLOCK_LEVELS leaves, each in a row of its own, and the blocks' roots again, until one is left. No depth is ever assumed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediastrata.functions.hashing import HASHERS, SLAB_BYTES, Hashing, blake3_many, hash_column, slabs, together

EMPTY_ROOT = "00" * 32
#: Levels of a tree that the fold in blocks takes at a time.
BLOCK_LEVELS = 12
PATH = "array<struct<is_left: boolean, hash: string>>"


def leaves(chunks: DataFrame, keys: list[str], data: str = "data", algorithm: str = "sha256") -> DataFrame:
    """The chunks' hashes (hex); payloads go no further than this map."""
    return chunks.withColumn("hash", F.lower(F.hex(hash_column(F.col(data), algorithm)))).drop(data)


def _depth(nodes: Column) -> Column:
    """The levels above an array of leaves, or one more."""
    return F.length(F.bin(F.size(nodes).cast("bigint")))


def _parents(nodes: Column) -> Column:
    """SHA-256 of each pair of an array of hex hashes; a last one without a partner as it is."""
    pairs = F.sequence(F.lit(0), ((F.size(nodes) - 1) / 2).cast("int"))
    joined = lambda i: F.sha2(F.unhex(F.concat(F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1))), 256)
    return F.transform(pairs, lambda i: F.when(2 * i + 1 < F.size(nodes), joined(i)).otherwise(F.get(nodes, 2 * i)))


def root_of(hashes: Column) -> Column:
    """The SHA-256 root (hex) of an array of hex hashes, in order."""
    folded = F.aggregate(F.sequence(F.lit(1), _depth(hashes)), hashes, lambda nodes, _: F.when(F.size(nodes) <= 1, nodes).otherwise(_parents(nodes)))
    return F.when(F.size(hashes) == 0, F.lit(EMPTY_ROOT)).otherwise(F.get(folded, F.lit(0)))


@F.arrow_udf(T.StringType())
def _blake3_root(hashes: pa.Array) -> pa.Array:
    out = []
    for slab in slabs(hashes.to_pylist(), lambda h: 96 * len(h or ()), SLAB_BYTES):
        grown = iter(together([growing([bytes.fromhex(x) for x in h]) for h in slab if h is not None]))
        out += [None if h is None else next(grown)[-1][0].hex() for h in slab]
    return pa.array(out, pa.string())


def growing(nodes: list[bytes]) -> Hashing[list[list[bytes]]]:
    """The levels of one small tree, from leaves to root, whose hashes another makes; see hashing.together."""
    levels = [nodes or [bytes(32)]]
    while len(levels[-1]) > 1:
        below = levels[-1]
        odd = below[len(below) & ~1 :]
        levels.append((yield [below[i] + below[i + 1] for i in range(0, len(below) - 1, 2)]) + odd)
    return levels


def tree(nodes: list[bytes], algorithm: str = "blake3") -> list[list[bytes]]:
    """The levels of one small tree, from leaves to root."""
    job, hashes = growing(nodes), None
    while True:
        try:
            wanted = job.send(hashes)
        except StopIteration as e:
            return e.value
        hashes = blake3_many(wanted) if algorithm == "blake3" else [HASHERS[algorithm](x) for x in wanted]


def _fold(nodes: Column, algorithm: str) -> Column:
    return root_of(nodes) if algorithm == "sha256" else _blake3_root(nodes)


def _gathered(rows: DataFrame, keys: list[str], order: str, *more: Column) -> DataFrame:
    """keys, and the rows' hashes in order as __nodes."""
    own = rows.groupBy(*keys).agg(*more, F.sort_array(F.collect_list(F.struct(order, "hash"))).alias("__rows"))
    return own.withColumn("__nodes", F.col("__rows")["hash"])


def roots(hashed: DataFrame, keys: list[str], order: str = "chunk_index", algorithm: str = "sha256") -> DataFrame:
    """keys, n_chunks and merkle_root of tracks whose leaves (column hash) fit a row; use root_by_levels for longer ones."""
    own = _gathered(hashed, keys, order, F.count("hash").alias("n_chunks"))
    return own.select(*keys, "n_chunks", _fold(F.col("__nodes"), algorithm).alias("merkle_root"))


def positions(hashed: DataFrame, keys: list[str], order: str = "chunk_index") -> DataFrame:
    """keys, pos (from 0) and hash: places by order, from places inside runs of the order's numbers and the counts of earlier runs."""
    rows = hashed.select(*keys, F.col(order).alias("__at"), F.floor(F.col(order) / (1 << BLOCK_LEVELS)).alias("__run"), "hash")
    earlier = Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "__run").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*keys, "__run").orderBy("__at")) - 1
    return rows.withColumn("__k", inside).join(counts, [*keys, "__run"]).select(*keys, (F.col("__before") + F.col("__k")).cast("bigint").alias("pos"), "hash")


def _most(hashed: DataFrame, keys: list[str]) -> int:
    return hashed.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _blocks(placed: DataFrame, keys: list[str]) -> DataFrame:
    return _gathered(placed.withColumn("__block", F.floor(F.col("pos") / (1 << BLOCK_LEVELS)).cast("bigint")), [*keys, "__block"], "pos")


def root_by_levels(hashed: DataFrame, keys: list[str], order: str = "chunk_index", algorithm: str = "sha256") -> DataFrame:
    """keys and merkle_root of trees of any size: their blocks are dealt out over tasks, as often as the largest tree needs."""
    most = _most(hashed, keys)
    placed = positions(hashed, keys, order)
    while True:
        placed = _blocks(placed, keys).select(*keys, F.col("__block").alias("pos"), _fold(F.col("__nodes"), algorithm).alias("hash"))
        most = -(-most // (1 << BLOCK_LEVELS))
        if most <= 1:
            return placed.select(*keys, F.col("hash").alias("merkle_root"))


def node_levels(hashed: DataFrame, keys: list[str], order: str = "chunk_index", algorithm: str = "sha256") -> list[DataFrame]:
    """(keys, pos, hash) of each level from leaves to root, as many as the largest tree has: a level is one aggregation of the one below."""
    out = [positions(hashed, keys, order)]
    for _ in range(max(0, _most(hashed, keys) - 1).bit_length()):
        pairs = out[-1].groupBy(*keys, F.floor(F.col("pos") / 2).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("hash"))).alias("l"), F.max(F.when(F.col("pos") % 2 == 1, F.col("hash"))).alias("r")
        )
        joined = F.lower(F.hex(hash_column(F.unhex(F.concat("l", "r")), algorithm)))
        out.append(pairs.select(*keys, "pos", F.when(F.col("r").isNull(), F.col("l")).otherwise(joined).alias("hash")))
    return out


def _paths(own: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos (in __nodes), hash and the SHA-256 path of every node of a row's tree; paths are made in the row, so that none carries the tree."""
    levels = F.aggregate(
        F.sequence(F.lit(1), _depth(F.col("__nodes"))), F.array(F.col("__nodes")),
        lambda done, _: F.when(F.size(F.element_at(done, -1)) <= 1, done).otherwise(F.concat(done, F.array(_parents(F.element_at(done, -1))))),
    )
    made = own.select(*keys, levels.alias("__levels"))

    def step(level: Column, k: Column, pos: Column) -> Column:
        mine = F.call_function("shiftright", pos, k)
        sibling = mine.bitwiseXOR(F.lit(1))
        return F.when((F.size(level) > 1) & (sibling < F.size(level)), F.struct((mine % 2 == 1).alias("is_left"), F.get(level, sibling).alias("hash")))

    def leaf(h: Column, pos: Column) -> Column:
        path = F.array_compact(F.transform(F.col("__levels"), lambda level, k: step(level, k, pos)))
        return F.struct(pos.cast("bigint").alias("pos"), h.alias("hash"), path.cast(PATH).alias("path"))

    return made.select(*keys, F.explode(F.transform(F.col("__levels")[0], leaf)).alias("__leaf")).select(*keys, "__leaf.*")


def proofs(hashed: DataFrame, keys: list[str], order: str = "chunk_index") -> DataFrame:
    """keys, pos, hash, path: the SHA-256 proof of every leaf of tracks that fit a row. A step names the sibling's side and hash; a promoted node has no step."""
    return _paths(_gathered(hashed, keys, order), keys)


def proofs_by_levels(hashed: DataFrame, keys: list[str], order: str = "chunk_index") -> DataFrame:
    """The same for trees of any size: a leaf's path is that in its block, then the block's in the tree of blocks."""
    return _block_proofs(positions(hashed, keys, order), keys, _most(hashed, keys))


def _block_proofs(placed: DataFrame, keys: list[str], most: int) -> DataFrame:
    blocks = _blocks(placed, keys)
    inside = _paths(blocks, [*keys, "__block"])
    at = (F.shiftleft("__block", BLOCK_LEVELS) + F.col("pos")).alias("pos")
    if most <= 1 << BLOCK_LEVELS:
        return inside.select(*keys, at, "hash", "path")
    above = blocks.select(*keys, F.col("__block").alias("pos"), root_of(F.col("__nodes")).alias("hash"))
    upper = _block_proofs(above, keys, -(-most // (1 << BLOCK_LEVELS))).select(*keys, F.col("pos").alias("__block"), F.col("path").alias("__upper"))
    return inside.join(upper, [*keys, "__block"]).select(*keys, at, "hash", F.concat("path", "__upper").alias("path"))


def verify_path(leaf: Column, path: Column, root: Column) -> Column:
    """Whether the SHA-256 fold of a leaf over its path is the root. Hashes that aren't 32 bytes of hex make it false."""
    hexed = lambda h: F.coalesce(h.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    sound = hexed(leaf) & F.forall(path, lambda s: hexed(s["hash"]))
    node = F.aggregate(path, F.lower(leaf), lambda at, s: F.sha2(F.unhex(F.when(s["is_left"], F.concat(s["hash"], at)).otherwise(F.concat(at, s["hash"]))), 256))
    return F.coalesce(F.when(sound, node == F.lower(root)), F.lit(False))
