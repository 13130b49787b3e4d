"""Chunk index tables: offsets, container tables, and which index of a track counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_offsets(chunks: DataFrame, work: list[str], order: list[str], size: str = "size", offset: str = "offset") -> DataFrame:
    """Offsets that run on over a work's tracks in order."""
    before = Window.partitionBy(*work).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn(offset, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("bigint"))


def track_table(chunks: DataFrame, keys: list[str], size: str = "size") -> DataFrame:
    """keys, total_chunks, chunk_size (the largest) and data_length of each track."""
    return chunks.groupBy(*keys).agg(F.count("*").alias("total_chunks"), F.max(size).cast("bigint").alias("chunk_size"), F.sum(size).cast("bigint").alias("data_length"))


def generated_index(tracks: DataFrame, chunks: DataFrame, work: list[str], track: str = "track_id") -> DataFrame:
    """work, track, chunk_index, offset, size of chunks in payload order (ordinal), dealt to the tracks in turn.

    A table that says more or fewer chunks than there are gives an error column, not a partial index: see index_errors.
    """
    upto = Window.partitionBy(*work).orderBy(track)
    spans = tracks.withColumn("__end", F.sum("total_chunks").over(upto)).withColumn("__start", F.col("__end") - F.col("total_chunks"))
    along = Window.partitionBy(*work).orderBy("ordinal")
    numbered = with_offsets(chunks, work, ["ordinal"]).withColumn("__k", F.row_number().over(along) - 1)
    placed = numbered.join(spans.select(*work, track, "__start", "__end"), work).where((F.col("__k") >= F.col("__start")) & (F.col("__k") < F.col("__end")))
    return placed.select(*work, track, (F.col("__k") - F.col("__start")).cast("bigint").alias("chunk_index"), "offset", "size")


def index_errors(tracks: DataFrame, chunks: DataFrame, work: list[str]) -> DataFrame:
    """work, expected, found of works whose track table and chunks disagree in number."""
    said = tracks.groupBy(*work).agg(F.sum("total_chunks").cast("bigint").alias("expected"))
    had = chunks.groupBy(*work).agg(F.count("*").alias("found"))
    both = said.join(had, work, "full_outer").na.fill(0, ["expected", "found"])
    return both.where("expected <> found")


def sequential(tracks: DataFrame, keys: list[str], total: str = "total_chunks", size: str = "chunk_size", length: str = "data_size") -> DataFrame:
    """keys, chunk_index, offset, size: equal chunks one after the other, the last ones cut to the data (0 past its end)."""
    rows = tracks.where(F.col(total) > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(total).cast("bigint") - 1)))
    offset = F.col("chunk_index") * F.col(size)
    return rows.select(*keys, "chunk_index", offset.cast("bigint").alias("offset"), F.greatest(F.lit(0), F.least(F.col(size), F.col(length) - offset)).cast("bigint").alias("size"))


def resolve(tracks: DataFrame, container: DataFrame, manifest: DataFrame, synthetic: DataFrame, keys: list[str], for_extraction: bool = False) -> DataFrame:
    """The one index that counts for each track: keys, source, chunk_index, offset, size.

    The container's, if the track has rows there; else the manifest's; else the synthetic one. For extraction the synthetic one
    counts for works of a single track only.
    """
    own = ["chunk_index", "offset", "size"]
    of = lambda df, rank: df.select(*keys, *own, F.lit(rank).alias("__rank"))
    if for_extraction:
        single = tracks.groupBy(*keys[:-1]).agg(F.count("*").alias("__n")).where("__n = 1").drop("__n") if len(keys) > 1 else tracks.select(*keys)
        synthetic = synthetic.join(single, keys[:-1] if len(keys) > 1 else keys, "left_semi")
    every = of(container, 0).unionByName(of(manifest, 1)).unionByName(of(synthetic, 2))
    best = every.groupBy(*keys).agg(F.min("__rank").alias("__rank"))
    names = F.element_at(F.array(F.lit("container"), F.lit("manifest"), F.lit("sequential")), F.col("__rank") + 1)
    return every.join(best, [*keys, "__rank"]).select(*keys, names.alias("source"), *own)


def proof_places(proofs: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Where each proof's chunk stands: by the track's entry of its index; where the track has no entries, by the proofs' running sizes.

    Adds offset and size, null where the track has entries but not this one. Of duplicate entries the last (by offset) counts.
    """
    entry = entries.groupBy(*keys, "chunk_index").agg(F.max("offset").alias("__offset"), F.max_by("size", "offset").alias("__size"))
    indexed = entries.select(*keys).distinct().withColumn("__indexed", F.lit(True))
    along = Window.partitionBy(*keys).orderBy("proof_ord").rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum("chunk_size").over(along), F.lit(0))
    rows = proofs.withColumn("__running", running).join(entry, [*keys, "chunk_index"], "left").join(indexed, keys, "left")
    by_index = F.coalesce("__indexed", F.lit(False))
    return rows.withColumn("offset", F.when(by_index, F.col("__offset")).otherwise(F.col("__running")).cast("bigint")).withColumn("size", F.when(by_index, F.col("__size")).otherwise(F.col("chunk_size")).cast("bigint")).drop("__running", "__offset", "__size", "__indexed")


def extra_bytes(proofs: DataFrame, files: DataFrame, work: list[str]) -> DataFrame:
    """work, consumed, file_length, extra: whether a derivative's file holds more or less than its proofs account for."""
    used = proofs.groupBy(*work).agg(F.sum("chunk_size").cast("bigint").alias("__proved"))
    rows = files.join(used, work, "left").withColumn("consumed", F.col("data_start") + F.coalesce("__proved", F.lit(0)))
    return rows.select(*work, "consumed", "file_length", (F.col("consumed") != F.col("file_length")).alias("extra"))


def track_ids(container: DataFrame, index: DataFrame, manifest: DataFrame, work: list[str], track: str = "track_id") -> DataFrame:
    """work and track: from the container's table, else the index, else the manifest; sorted ids without repeats are the caller's orderBy."""
    every = None
    for rank, df in enumerate((container, index, manifest)):
        part = df.select(*work, track, F.lit(rank).alias("__rank")).distinct()
        every = part if every is None else every.unionByName(part)
    best = every.groupBy(*work).agg(F.min("__rank").alias("__rank"))
    return every.join(best, [*work, "__rank"]).select(*work, track)


def chunk_bytes(data: Column, offset: Column, size: Column) -> Column:
    """A chunk of a payload; an error where it isn't inside."""
    inside = (offset >= 0) & (size >= 0) & (offset + size <= F.octet_length(data))
    return F.when(inside, F.substring(data, (offset + 1).cast("int"), size.cast("int"))).otherwise(F.raise_error(F.lit("Requested data outside of track data section")).cast("binary"))


def read_chunk(data: Column, offset: Column, size: Column) -> Column:
    """struct(bytes, error): a chunk of a payload, or why it can't be read."""
    error = F.when((offset < 0) | (size < 0), "Invalid range").when(offset + size > F.octet_length(data), "Requested data outside of track data section")
    return F.struct(F.when(error.isNull(), F.substring(data, (offset + 1).cast("int"), size.cast("int"))).alias("bytes"), error.alias("error"))


def read_fixed(data: Column, number: Column, chunk_size: Column) -> Column:
    """The same of the number-th chunk of equal chunks; a short last one isn't inside."""
    return read_chunk(data, number * chunk_size, chunk_size)
