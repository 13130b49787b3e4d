"""Packing by cutting-stock column generation.

Documents are tokenized, cut into full sequences and a remainder, and the remainders' lengths counted in a histogram of
a fixed number of classes. A linear program over patterns (how many pieces of each class share a sequence) is solved by
the revised simplex method; a knapsack dynamic program over the dual prices finds each entering column. Patterns are
rounded down, what is left over is packed greedily, and pieces, ranked inside their class, take the patterns' places.

The histogram and the patterns, whose sizes the classes bound, are one task's. Ranks are made of a rank
inside a (class, bucket) and the counts of the class's earlier buckets, so a class with a third of all pieces is
spread over as many tasks as it has buckets.

Defined cases: a null text counts as empty; every document has its end id, so an empty one is a piece of one token;
pieces that are alike in everything take each other's places; an empty table gives no rows; a text of any length is cut
into full sequences and a rest; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediastrata.llm.common import materialize, slices, table, text_list
from mediastrata.llm.tokens import ID, encoder

CAPACITY = 4096
#: Class bounds are multiples of UNIT tokens, and grow by at most RATIO from one to the next.
UNIT, RATIO = 4, 1.008
#: The program stops when its value is proven to be within this of the optimum.
GAP = 0.001
MAX_COLUMNS = 6000
#: Pieces in a rank bucket, on average.
BUCKET_ROWS = 20_000


@lru_cache(maxsize=4)
def class_bounds(capacity: int = CAPACITY, unit: int = UNIT, ratio: float = RATIO) -> tuple[int, ...]:
    """The largest length of each class, in tokens."""
    bounds = [unit]
    while bounds[-1] < capacity:
        bounds.append(min(capacity, max(bounds[-1] + unit, int(bounds[-1] * ratio) // unit * unit)))
    return tuple(bounds)


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The counts of items of the largest total value that fit, with any number of each: one sweep over items, vectorized over capacities."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1, dtype=np.int64)
    copies = np.zeros(capacity + 1, dtype=np.int64)
    order = [i for i in np.argsort(-values / sizes, kind="stable") if values[i] > 1e-12]
    least = capacity + 1
    for i in order:  # by falling density: an item that is no smaller than a denser one rarely helps, but may
        size, value, k = int(sizes[i]), values[i], 1
        least = min(least, size)
        while k * size <= capacity:
            with_it = best[:-k * size] + k * value
            better = np.flatnonzero(with_it > best[k * size :] + 1e-12)
            if not len(better):
                break
            at = better + k * size
            best[at] = with_it[better]
            last[at], copies[at] = i, k
            k *= 2
    # best[c] may come from a state improved later for the same prefix; replaying greedily keeps every step feasible.
    counts = np.zeros(len(values), dtype=np.int64)
    c = int(best.argmax())
    while c > 0 and last[c] >= 0:
        counts[last[c]] += copies[c]
        c -= int(copies[c] * sizes[last[c]])
    return float(counts @ values), counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, max_columns: int = MAX_COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used (fractions): minimal number of sequences that cover the demand."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / (capacity // sizes))
    used = demand / (capacity // sizes)
    cost, bound = np.ones(m), float(sizes @ demand) / capacity  # no packing is fuller than full
    for _ in range(max_columns):
        prices = cost @ inverse
        i = int(prices.argmin())
        if prices[i] < -1e-9:  # more of a class than asked for
            column, price = -np.eye(m)[i], 0.0
        else:
            value, counts = knapsack(np.maximum(prices, 0), sizes, capacity)
            bound = max(bound, float(cost @ used) / max(value, 1e-9))  # the prices, divided by value, are dual feasible
            if value <= 1 + 1e-9 or float(cost @ used) <= bound * (1 + gap):
                break
            column, price = counts.astype(float), 1.0
        direction = inverse @ column
        up = direction > 1e-9
        if not up.any():
            break
        ratios = np.where(up, used / np.where(up, direction, 1), np.inf)
        out = int(ratios.argmin())
        theta = max(0.0, ratios[out])
        used = used - theta * direction
        used[out] = theta
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        basis[:, out], cost[out] = column, price
    real = cost > 0
    return basis[:, real].T.round().astype(np.int64), np.maximum(used[real], 0)


def patterns(histogram: dict[int, int], bounds: tuple[int, ...], capacity: int = CAPACITY, unit: int = UNIT) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(times, classes, pieces of each) for whole numbers of sequences that hold every piece of the histogram once."""
    classes = np.array(sorted(c for c, n in histogram.items() if n), dtype=np.int64)
    if not len(classes):
        return []
    left = np.array([histogram[c] for c in classes], dtype=np.int64)
    sizes, room = np.array([bounds[c] // unit for c in classes]), capacity // unit
    made: list[tuple[int, np.ndarray]] = []
    columns, times = solve(sizes, left.astype(float), room)
    for k in np.argsort(-times, kind="stable"):
        a = columns[k]
        n = int(min(np.floor(times[k] + 1e-6), (left[a > 0] // a[a > 0]).min())) if a.any() else 0
        if n > 0:
            made.append((n, a))
            left = left - n * a
    while left.any():  # what the rounding left over: largest first, the same filling as often as it can be repeated
        a, free = np.zeros(len(classes), dtype=np.int64), room
        for i in range(len(classes) - 1, -1, -1):
            a[i] = min(left[i], free // sizes[i])
            free -= a[i] * sizes[i]
        n = int((left[a > 0] // a[a > 0]).min())
        made.append((n, a))
        left = left - n * a
    return [(n, classes[np.flatnonzero(a)], a[a > 0]) for n, a in made]


def _pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    bounds = np.array(class_bounds(capacity))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(tokenizer), np.array([end_id], dtype=ID).tobytes()
        for batch in (part for whole in batches for part in slices(whole)):
            rows, ids_of = [], []
            for doc, ids in zip(batch.column(0).to_pylist(), e.encode_batch(text_list(batch.column(1))), strict=True):
                ids += end
                n, view = len(ids) // 4, memoryview(ids)
                for start in range(0, n, capacity):
                    part = view[4 * start : 4 * (start + capacity)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n))
                    if with_ids:
                        ids_of.append(np.frombuffer(part, dtype=ID).astype(np.int64))
            doc, start, length, crc, n = zip(*rows, strict=True) if rows else [[]] * 5
            arrays = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, n)] + [pa.array(np.searchsorted(bounds, length, side="left").astype(np.int32))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(ids_of, pa.list_(pa.int64()))] if with_ids else []), names=names + ["ids"] * with_ids)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int" + ", ids array<bigint>" * with_ids
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def _places(capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From the histogram (class, n), where the ranks of each class go: ranks low to high fill sequences from first_sequence, so many in each.

    It runs in a task, whose numerical library has one thread, and not in the driver's process.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histogram = {c: n for batch in batches for c, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)}
        rows, sequence, given = [], 0, dict.fromkeys(histogram, 0)
        for times, classes, counts in patterns(histogram, class_bounds(capacity), capacity):
            for c, a in zip(classes.tolist(), counts.tolist(), strict=True):
                rows.append((c, given[c], given[c] + times * a, sequence, a))
                given[c] += times * a
            sequence += times
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = [pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["class", "low", "high", "first_sequence", "each"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with with_ids its ids."""
    spark = docs.sparkSession
    pieces = materialize(_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids), "pieces")
    histogram = pieces.groupBy("class").agg(F.count("*").alias("n"))  # at most one row for each class
    places = materialize(histogram.coalesce(1).mapInArrow(_places(capacity), "class int, low bigint, high bigint, first_sequence bigint, each bigint"), "places")
    total = pieces.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = dealt.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("class", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("class", "bucket").orderBy(*order)
    ranked = dealt.withColumn("local", F.row_number().over(inside) - 1).join(counts, ["class", "bucket"]).withColumn("rank", F.col("local") + F.col("before"))
    at = F.broadcast(places)  # some classes' worth of patterns, whatever the input
    placed = ranked.join(at, (ranked["class"] == at["class"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.col("first_sequence") + F.floor((F.col("rank") - F.col("low")) / F.col("each")).cast("bigint"))
    along = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0)))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] * with_ids))


def production_pack(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return production_pack(table(spark, sf_dir, "documents"))
