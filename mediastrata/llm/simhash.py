"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in at most 3 of 64 bits agree, but for one bit at most, on one of their 32-bit halves. On each half
the anchors are the words of a covering code: a perfect Hamming code of length 31 beside one free bit, of covering radius 1.
Every half has an anchor within the radius (its home), and a half one bit away is within radius + 1 = 2 of it. So
each fingerprint is replicated to the 17 anchors (2 if it is one) within 2 of either half, and fingerprints are compared
per anchor, homes with all. That finds every link.

Equal fingerprints are one row before anything is compared. An anchor gives a spanning forest of its links, never all
pairs. Homes of a crowded anchor are dealt out over several tasks; each holds its share of the homes, and the other
fingerprints stream past them. Components come from alternating star contractions on tables in the shared folder;
nothing that grows with the input reaches the driver.

Defined cases: a text that is null or has no word has fingerprint zero, which links like any other; repeated ids are
separate documents that happen to have the same id; null ids never name a component unless all its ids are null;
an empty table gives no rows; a text of any length is hashed whole; other columns pass through the filter, whatever
their names; of documents that share the least id of a component, the filter keeps one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediastrata.llm.common import Transform, drop, materialize, materialized, table, text_list, whole_row, with_columns

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: Homes of one anchor that one task compares.
CROWD = 4096
#: Rows that a task compares at a time.
HELD = 50_000
_CHUNK = 1 << 16


def fingerprint(text: str) -> int:
    """The SimHash of a whole text's word shingles, as a signed 64-bit integer."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z are lowered, only ASCII's blanks separate
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else iter([b" ".join(words)])
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprinted(docs: DataFrame, text_col: str, keep: dict[str, Column]) -> DataFrame:
    """The columns in keep, and every whole text's fingerprint as fp."""

    def hasher() -> Transform:
        return lambda texts: [pa.array([fingerprint(t) for t in text_list(texts)], pa.int64())]

    return with_columns(docs, F.col(f"`{text_col}`"), keep, "fp bigint", hasher)


def syndromes(x: np.ndarray) -> np.ndarray:
    """Of the low 31 bits of each word: the exclusive or of the positions (from 1) of its ones; zero for a code word."""
    out = np.zeros(len(x), dtype=np.int64)
    for j in range(5):
        mask = np.uint32(sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1))
        out |= (np.bitwise_count(x & mask).astype(np.int64) & 1) << j
    return out


def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All anchors within 2 of each 32-bit word: the word's row, the anchor, and whether it is the word's home."""
    bit = np.array([0] + [1 << (p - 1) for p in range(1, 32)], dtype=np.uint32)  # of syndrome 0: none
    s = syndromes(x)
    home = x ^ bit[s]
    rows, found, homes = [np.arange(len(x))] * 2, [home, home ^ np.uint32(1 << 31)], [np.ones(len(x), bool), np.zeros(len(x), bool)]
    off = np.flatnonzero(s)
    for a in range(1, 32):
        b = s[off] ^ a
        use = off[b > a]  # each pair of positions once; b is 0 for a = s, which is the home
        rows.append(use)
        found.append(x[use] ^ bit[a] ^ bit[s[use] ^ a])
        homes.append(np.zeros(len(use), bool))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(homes)


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, fp, home) for both halves; the half's number stands above the anchor's 32 bits."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for half in (0, 1):
            x = (fp.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)
            row, anchor, home = anchors(x)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64) | half << 32), pa.array(fp[row]), pa.array(home)], names=["anchor", "fp", "home"])


def forest(fps: np.ndarray, homes: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect whatever the links between the homes and all fingerprints connect, without a cycle."""
    label, out, words = np.arange(len(fps)), [], fps.view(np.uint64)
    for i in np.flatnonzero(homes):
        near = np.flatnonzero(np.bitwise_count(words ^ words[i]) <= distance)
        labels, first = np.unique(label[near], return_index=True)
        mine = label[i]
        others = labels != mine
        if others.any():
            out += [(int(fps[i]), int(fps[j])) for j in near[first[others]]]
            label[np.isin(label, labels)] = mine
    return out


def _groups(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole groups of equal keys, one after the other."""
    starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]))
    size = np.diff(starts)
    group = np.repeat(np.arange(len(size)), size)
    left, right, words = [], [], fp.view(np.uint64)
    small = size[group] <= 8
    for k in range(1, min(8, len(fp))):
        at = np.flatnonzero((group[k:] == group[:-k]) & small[k:] & (home[k:] | home[:-k]))
        at = at[np.bitwise_count(words[at] ^ words[at + k]) <= DISTANCE]
        left.append(fp[at])
        right.append(fp[at + k])
    pairs = [p for g in np.flatnonzero(size > 8) for p in forest(fp[starts[g] : starts[g + 1]], home[starts[g] : starts[g + 1]])]
    if pairs:
        a, b = np.array(pairs, dtype=np.int64).T
        left.append(a)
        right.append(b)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition whose rows (anchor, salt, fp, home) are sorted by anchor and salt, a group's homes first.

    At most HELD rows and one group's homes are held at a time: the rest of a group that is larger streams past its homes.
    """

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        anchor, salt, fp, home = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        return np.stack([anchor, salt.astype(np.int64)], axis=1), fp, home

    def emit(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        a, b = _groups(key, fp, home)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(columns(batch))
        rows += batch.num_rows
        if rows < HELD:
            continue
        key, fp, home = (np.concatenate(x) for x in zip(*held, strict=True))
        whole = np.flatnonzero((key != key[-1]).any(axis=1))  # rows of groups that have ended
        cut = int(whole[-1]) + 1 if len(whole) else 0
        if cut:
            yield emit(key[:cut], fp[:cut], home[:cut])
            key, fp, home = key[cut:], fp[cut:], home[cut:]
        if len(key) >= HELD and 2 * home.sum() <= len(key):  # the open group: what has come of it meets its homes, which stay
            yield emit(key, fp, home)
            key, fp, home = key[home], fp[home], home[home]
        held, rows = [(key, fp, home)], len(key)
    if held:
        yield emit(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: links between the distinct fingerprints (column fp) that connect all that are within DISTANCE, each once."""
    replicas = distinct.select("fp").mapInArrow(_replicas, "anchor bigint, fp bigint, home boolean")
    homes = replicas.where("home").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    crowded = materialize(homes.select("anchor", F.ceil(F.col("n") / crowd).cast("int").alias("salts")), "crowded")
    if crowded.isEmpty():
        dealt = replicas.withColumn("salt", F.lit(0))
    else:  # a home goes to its own salt; the others, to which it is compared, to each
        known = replicas.join(crowded, "anchor", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
        dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("home", F.col("home") & (F.col("salt") == own)).select("anchor", "fp", "home", "salt")
    dealt = dealt.select("anchor", "salt", "fp", "home").repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", F.desc("home"))
    return dealt.mapInArrow(_links, "a bigint, b bigint").where("a <> b").dropDuplicates(["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for each end of an edge: root is its component's smallest fingerprint. Alternating large and small stars."""
    edges, path = materialized(edges.select("a", "b"), "links")

    def large_star(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        least = e.groupBy("b").agg(F.min("a").alias("m"))  # a < b in every edge
        out = e.join(least, "b")
        return out.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").union(least.select(F.col("m").alias("a"), "b")).distinct()

    mark = None
    while True:
        before = path
        edges, path = materialized(small_star(large_star(edges)), "stars")
        drop(edges.sparkSession, before)
        found = edges.agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("sa"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(found) == mark:
            return edges.select(F.col("b").alias("fp"), F.col("a").alias("root"))
        mark = tuple(found)


def classes(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fp, least, root, component_id) for each fingerprint of a written table (id, fp); least is its smallest id, component_id the component's."""
    distinct = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("id")), "fingerprints")
    roots = components(links(distinct))
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = roots.join(distinct, "fp").select("root", "id").union(roots.select("root").distinct().join(distinct, F.col("root") == F.col("fp")).select("root", "id"))
    least = linked.groupBy("root").agg(F.min("id").alias("component"))
    return rooted.join(least, "root", "left").select("fp", F.col("id").alias("least"), "root", F.coalesce("component", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, fingerprint (hex) and component_id."""
    rows = materialize(fingerprinted(docs, text_col, {"id": F.col(f"`{id_col}`")}), "fingerprinted")
    found = rows.join(classes(rows, "id").select("fp", "component_id"), "fp")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with the columns of docs: that of the smallest id."""
    rows = materialize(fingerprinted(docs, text_col, {"id": F.col(f"`{id_col}`"), "row": whole_row(docs)}), "fingerprinted")
    least = classes(rows, "id").where(F.col("least").eqNullSafe(F.col("component_id")))
    first = least.groupBy("root").agg(F.min(F.struct("fp", "least")).alias("k")).select("root", F.col("k.fp").alias("own"), "k.least")
    # By fingerprint and id, of which no pair is common, rather than by fingerprint, which a third of all documents may share.
    kept = rows.join(first, (F.col("fp") == F.col("own")) & F.col("id").eqNullSafe(F.col("least")))
    return kept.select("root", "row").dropDuplicates(["root"]).select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
