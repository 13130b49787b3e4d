"""Registered queries of the provenance operators on the driver's tables, each with its DuckDB SQL.

Documents play opaque media (one work each, its UTF-8 bytes cut into chunks), pages a second track, events timed tracks, conversations
chains of derivation, lineitem chunk indexes, customers authors and signers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediastrata.functions import codec_facts, detect, timecode
from mediastrata.functions.ed25519 import SigningKey
from mediastrata.operators import chunking, entries, merkle, policy, ranges
from mediastrata.plans import manifests, works
from mediastrata.sources.staging import written
from mediastrata.streaming import verifier

Query = Callable[[SparkSession, str], DataFrame]
CAP = 256
TTP = "ttp"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- chunks and Merkle trees ---

_CHUNKS_SQL = f"""c AS (SELECT doc_id, i AS chunk_index, substr(h, {2 * CAP} * i + 1, {2 * CAP}) AS x
  FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 + {CAP - 1}) // {CAP})) AS i FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents)))"""
_LEVELS_SQL = (
    _CHUNKS_SQL
    + """, t(doc_id, level, nodes) AS (
  SELECT doc_id, 0, list(sha256(unhex(x)) ORDER BY chunk_index) FROM c GROUP BY doc_id
  UNION ALL
  SELECT doc_id, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: CASE WHEN 2 * i + 2 <= len(nodes) THEN sha256(unhex(nodes[2 * i + 1] || nodes[2 * i + 2])) ELSE nodes[2 * i + 1] END)
  FROM t WHERE len(nodes) > 1)"""
)


def _document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    return chunking.fixed_size(docs, F.col("bytes"), CAP).drop("bytes")


def _hashed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _document_chunks(spark, sf_dir).withColumn("size", F.octet_length("data").cast("bigint"))
    return merkle.leaves(chunks, ["doc_id"])


@query(f"WITH {_CHUNKS_SQL} SELECT doc_id, chunk_index, len(x) // 2 AS size, sha256(unhex(x)) AS hash FROM c")
def chunk_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed_chunks(spark, sf_dir).select("doc_id", "chunk_index", "size", "hash")


@query(f"WITH RECURSIVE {_LEVELS_SQL} SELECT doc_id, n_chunks, nodes[1] AS merkle_root FROM t JOIN (SELECT doc_id, count(*) AS n_chunks FROM c GROUP BY doc_id) USING (doc_id) WHERE len(nodes) = 1")
def merkle_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.roots(_hashed_chunks(spark, sf_dir), ["doc_id"])


@query(f"WITH RECURSIVE {_LEVELS_SQL} SELECT doc_id, nodes[1] AS merkle_root FROM t WHERE len(nodes) = 1")
def merkle_roots_by_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.root_by_levels(_hashed_chunks(spark, sf_dir), ["doc_id"])


_PROOFS_SQL = (
    _LEVELS_SQL
    + """, leaf AS (SELECT doc_id, unnest(range(0, len(nodes))) AS pos FROM t WHERE level = 0),
step AS (SELECT leaf.doc_id, pos, level, (pos >> level) & 1 AS odd, nodes[xor(pos >> level, 1) + 1] AS sibling
         FROM leaf JOIN t ON t.doc_id = leaf.doc_id WHERE len(nodes) > 1)"""
)


@query(
    f"WITH RECURSIVE {_PROOFS_SQL} SELECT leaf.doc_id, leaf.pos, coalesce(string_agg(CASE WHEN odd = 1 THEN 'L' ELSE 'R' END || sibling, ',' ORDER BY level) FILTER (sibling IS NOT NULL), '') AS path"
    " FROM leaf LEFT JOIN step ON step.doc_id = leaf.doc_id AND step.pos = leaf.pos GROUP BY leaf.doc_id, leaf.pos"
)
def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.transform("path", lambda s: F.concat(F.when(s["is_left"], "L").otherwise("R"), s["hash"]))
    return merkle.proofs(_hashed_chunks(spark, sf_dir), ["doc_id"]).select("doc_id", "pos", F.array_join(steps, ",").alias("path"))


@query(f"WITH {_CHUNKS_SQL} SELECT doc_id, count(*) AS n_proofs, count(*) AS n_valid, 0::BIGINT AS n_tampered_valid FROM c GROUP BY doc_id")
def proof_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every proof verifies, and none does with the first digit of its leaf changed."""
    hashed = _hashed_chunks(spark, sf_dir)
    proofs = merkle.proofs(hashed, ["doc_id"]).join(merkle.roots(hashed, ["doc_id"]), "doc_id")
    other = F.concat(F.translate(F.substring("hash", 1, 1), "0123456789abcdef", "123456789abcdef0"), F.substring("hash", 2, 63))
    valid = lambda leaf: F.sum(merkle.verify_path(leaf, F.col("path"), F.col("merkle_root")).cast("bigint"))
    return proofs.groupBy("doc_id").agg(F.count("*").alias("n_proofs"), valid(F.col("hash")).alias("n_valid"), valid(other).alias("n_tampered_valid"))


@query(f"WITH {_CHUNKS_SQL} SELECT sha256(unhex(x)) AS hash, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_works, min(doc_id) AS first_work FROM c GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def shared_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution: content that stands in several works."""
    works = _hashed_chunks(spark, sf_dir).groupBy("hash", "doc_id").agg(F.count("*").alias("n"))
    return works.groupBy("hash").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_works"), F.min("doc_id").alias("first_work")).where("n_works > 1")


_TRACKS_SQL = f"""b AS (SELECT doc_id AS work_id, 0::BIGINT AS track_id, strlen(text) AS n FROM documents UNION ALL SELECT page_id, 1, strlen(html) FROM pages),
k AS (SELECT work_id, track_id, i AS chunk_index, least({CAP}, n - i * {CAP}) AS size FROM (SELECT *, unnest(range(0, (n + {CAP - 1}) // {CAP})) AS i FROM b))"""


def _two_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("work_id"), F.lit(0).cast("bigint").alias("track_id"), F.encode("text", "UTF-8").alias("bytes"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("work_id"), F.lit(1).cast("bigint").alias("track_id"), F.encode("html", "UTF-8").alias("bytes"))
    chunks = chunking.fixed_size(docs.unionByName(pages), F.col("bytes"), CAP).drop("bytes")
    return chunks.select("work_id", "track_id", "chunk_index", F.octet_length("data").cast("bigint").alias("size"))


@query(f"WITH {_TRACKS_SQL} SELECT work_id, track_id, chunk_index, size, sum(size) OVER (PARTITION BY work_id ORDER BY track_id, chunk_index)::BIGINT - size AS \"offset\" FROM k")
def work_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.with_offsets(_two_tracks(spark, sf_dir), ["work_id"], ["track_id", "chunk_index"])


@query(f"WITH {_TRACKS_SQL} SELECT work_id, track_id, count(*) AS total_chunks, max(size) AS chunk_size, sum(size)::BIGINT AS data_length FROM k GROUP BY ALL")
def track_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.track_table(_two_tracks(spark, sf_dir), ["work_id", "track_id"])


@query(f"WITH {_TRACKS_SQL} SELECT work_id, track_id, chunk_index, size, sum(size) OVER (PARTITION BY work_id ORDER BY track_id, chunk_index)::BIGINT - size AS \"offset\" FROM k")
def generated_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _two_tracks(spark, sf_dir)
    tracks = entries.track_table(chunks, ["work_id", "track_id"])
    along = Window.partitionBy("work_id").orderBy("track_id", "chunk_index")
    return entries.generated_index(tracks, chunks.select("work_id", F.row_number().over(along).alias("ordinal"), "size"), ["work_id"])


@query(
    f"WITH {_TRACKS_SQL}, t AS (SELECT work_id, track_id, count(*) AS total, sum(size) AS n FROM k GROUP BY ALL)"
    f" SELECT work_id, track_id, i AS chunk_index, i * 100 AS \"offset\", greatest(0, least(100, n::BIGINT - i * 100)) AS size FROM (SELECT *, unnest(range(0, total)) AS i FROM t)"
)
def sequential_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = entries.track_table(_two_tracks(spark, sf_dir), ["work_id", "track_id"]).withColumn("chunk_size", F.lit(100).cast("bigint"))
    return entries.sequential(tracks, ["work_id", "track_id"], length="data_length")


_SOURCES_SQL = f"""{_TRACKS_SQL}, o AS (SELECT *, sum(size) OVER (PARTITION BY work_id ORDER BY track_id, chunk_index)::BIGINT - size AS "offset" FROM k),
s AS (SELECT 0 AS r, work_id, track_id, chunk_index, "offset", size FROM o WHERE work_id % 3 = 0 UNION ALL
      SELECT 1, work_id, track_id, chunk_index, "offset" + 7, size FROM o WHERE work_id % 3 <> 2 UNION ALL
      SELECT 2, work_id, track_id, chunk_index, "offset" + 9, size FROM o)"""


def _resolved(spark: SparkSession, sf_dir: str, for_extraction: bool) -> DataFrame:
    keys = ["work_id", "track_id"]
    chunks = entries.with_offsets(_two_tracks(spark, sf_dir), ["work_id"], ["track_id", "chunk_index"])
    moved = lambda by: chunks.withColumn("offset", F.col("offset") + by)
    return entries.resolve(chunks.select(*keys).distinct(), chunks.where("work_id % 3 = 0"), moved(7).where("work_id % 3 <> 2"), moved(9), keys, for_extraction)


@query(f"WITH {_SOURCES_SQL} SELECT work_id, track_id, ['container', 'manifest', 'sequential'][r + 1] AS source, chunk_index, \"offset\", size FROM s QUALIFY r = min(r) OVER (PARTITION BY work_id, track_id)")
def entry_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, False)


@query(
    f"WITH {_SOURCES_SQL}, one AS (SELECT work_id FROM k GROUP BY work_id HAVING count(DISTINCT track_id) = 1) SELECT work_id, track_id, ['container', 'manifest', 'sequential'][r + 1] AS source, chunk_index, \"offset\", size"
    " FROM (SELECT * FROM s WHERE r < 2 OR work_id IN (SELECT work_id FROM one)) QUALIFY r = min(r) OVER (PARTITION BY work_id, track_id)"
)
def entry_resolution_for_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, True)


@query(
    f"WITH {_TRACKS_SQL}, s AS (SELECT 0 AS r, work_id, track_id FROM k WHERE work_id % 2 = 0 UNION SELECT 1, work_id, track_id FROM k WHERE track_id = 0 UNION SELECT 2, work_id, track_id FROM k)"
    " SELECT work_id, track_id FROM s QUALIFY r = min(r) OVER (PARTITION BY work_id)"
)
def track_id_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _two_tracks(spark, sf_dir)
    return entries.track_ids(chunks.where("work_id % 2 = 0"), chunks.where("track_id = 0"), chunks, ["work_id"])


@query(f"WITH {_CHUNKS_SQL} SELECT doc_id, chunk_index, {CAP} * chunk_index AS \"offset\", len(x) // 2 AS size, upper(x) AS chunk FROM c")
def chunk_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of every document, read at its offset."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    length = F.octet_length("bytes").cast("bigint")
    starts = F.when(length > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((length - 1) / CAP)))

    def read(i: Column) -> Column:
        size = F.least(F.lit(CAP).cast("bigint"), length - i * CAP)
        return F.struct(i.alias("chunk_index"), (i * CAP).alias("offset"), size.alias("size"), F.hex(entries.chunk_bytes(F.col("bytes"), i * CAP, size)).alias("chunk"))

    return docs.select("doc_id", F.explode(F.transform(starts, read)).alias("c")).select("doc_id", "c.*")


# --- detection and codec facts ---

_PREFIXES = (
    "89504E470D0A1A0A", "FFD8FFE0", "474946383761", "474946383961", "524946460000000057454250", "0000001866747970686569630000000068656963", "00000018667479706D6966310000000000000000",
    "000000186674797069736F6D00000000686569780000", "1A45DFA3000000007765626D", "1A45DFA3000000006D6174726F736B61", "00000010000000006D6F6F7600000000", "0000000141414141", "0000000C6D6F6F76AAAAAAAA",
    "00000010616263640000000000000000000000106D6F6F760000000000000000", "",
)


def _prefixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.get(F.array(*map(F.lit, _PREFIXES)), (F.col("p_partkey") % len(_PREFIXES)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.unhex(prefix), F.encode("p_name", "UTF-8")).alias("data"))


_PREFIX_SQL = f"""p AS (SELECT p_partkey, {list(_PREFIXES)}[p_partkey % {len(_PREFIXES)} + 1] || hex(encode(p_name)) AS h FROM part),
d AS (SELECT p_partkey, h, len(h) // 2 AS n, substr(h, 9, 8) AS kind, ('0x' || substr(h, 1, 8))::BIGINT AS size FROM p)"""
_BRANDS_SQL = "('68656963', '68656978', '68657663', '68657678', '6D696631', '6D736631')"


@query(
    f"""WITH {_PREFIX_SQL} SELECT p_partkey, CASE WHEN starts_with(h, '89504E470D0A1A0A') THEN 'png' WHEN starts_with(h, 'FFD8FF') THEN 'jpg'
  WHEN starts_with(h, '474946383761') OR starts_with(h, '474946383961') THEN 'gif' WHEN starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250' THEN 'webp'
  WHEN n >= 16 AND kind = '66747970' AND (substr(h, 17, 8) IN {_BRANDS_SQL} OR (size BETWEEN 16 AND n AND len(list_filter(range(16, size - 3, 4), lambda i: substr(h, 2 * i + 1, 8) IN {_BRANDS_SQL})) > 0)) THEN 'heic' END AS image_type
  FROM d"""
)
def image_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prefixed(spark, sf_dir).select("p_partkey", detect.image_type(F.col("data")).alias("image_type"))


_LATER_SQL = "('66747970', '6D6F6F76', '6D6F6F66', '6D646174', '6A756D62', '6D657461')"


@query(
    f"""WITH RECURSIVE {_PREFIX_SQL}, w(p_partkey, h, n, pos) AS (SELECT p_partkey, h, least(n, 4096), 0::BIGINT FROM d UNION ALL
  SELECT p_partkey, h, n, pos + ('0x' || substr(h, 2 * pos + 1, 8))::BIGINT FROM w
  WHERE pos + 8 <= n AND substr(h, 2 * pos + 9, 8) NOT IN {_LATER_SQL} AND ('0x' || substr(h, 2 * pos + 1, 8))::BIGINT BETWEEN 8 AND n - pos),
f AS (SELECT DISTINCT p_partkey FROM w WHERE pos + 8 <= n AND substr(h, 2 * pos + 9, 8) IN {_LATER_SQL})
SELECT p_partkey, CASE WHEN n >= 12 AND regexp_full_match(kind, '((3[0-9])|(4[1-9A-F])|(5[0-9A])|(6[1-9A-F])|(7[0-9A])){{4}}')
    AND (kind IN ('66747970', '6D6F6F76', '6D6F6F66', '6D646174', '66726565', '736B6970', '77696465', '75756964', '6A756D62', '6D657461') OR p_partkey IN (SELECT p_partkey FROM f)) THEN 'mp4'
  WHEN starts_with(h, '1A45DFA3') THEN CASE WHEN contains(lower(substr(h, 1, 8192)), '7765626d') THEN 'webm' ELSE 'mkv' END END AS container_type FROM d"""
)
def container_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prefixed(spark, sf_dir).select("p_partkey", detect.container_type(F.col("data")).alias("container_type"))


_CODECS = ("h264", "H265", "hevc", "aac", "opus", "FLAC", "raw", "vp9")
_CONTAINERS = (None, "mp4", "jpeg", "HEIF", "png", "webm", "wav")
_TRACK_FACTS_SQL = f"""f AS (SELECT p_partkey, {list(_CODECS)}[p_partkey % 8 + 1] AS codec, [NULL, 'mp4', 'jpeg', 'HEIF', 'png', 'webm', 'wav'][p_partkey % 7 + 1] AS container,
  CASE WHEN p_size % 5 = 0 THEN p_size END AS width, CASE WHEN p_size % 3 = 0 THEN p_size END AS rate, ['jpg', 'heic', 'PNG', 'mp4', 'WebM'][p_partkey % 5 + 1] AS extension FROM part)"""


def _track_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("p_partkey") % len(values)).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", pick(_CODECS).alias("codec"), pick(_CONTAINERS).alias("container"), F.when(F.col("p_size") % 5 == 0, F.col("p_size")).alias("width"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("rate"), pick(("jpg", "heic", "PNG", "mp4", "WebM")).alias("extension"),
    )


@query(
    f"""WITH {_TRACK_FACTS_SQL} SELECT p_partkey, CASE WHEN lower(container) IN ('png', 'jpg', 'jpeg', 'gif', 'webp', 'heic', 'heif') THEN 'Image'
  WHEN width IS NOT NULL OR lower(codec) IN ('h264', 'h265', 'hevc') THEN 'Video' WHEN rate IS NOT NULL OR lower(codec) IN ('aac', 'opus', 'flac') THEN 'Audio' ELSE 'Unknown' END AS label,
  replace(replace(lower(extension), 'jpeg', 'jpg'), 'heif', 'heic') = replace(replace(lower(container), 'jpeg', 'jpg'), 'heif', 'heic') AS fits FROM f"""
)
def track_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("int")
    f = _track_facts(spark, sf_dir)
    return f.select("p_partkey", detect.track_label(F.col("container"), F.col("codec"), F.col("width"), none, F.col("rate"), none).alias("label"), detect.extension_matches(F.col("extension"), F.col("container")).alias("fits"))


@query(
    f"""WITH {_TRACK_FACTS_SQL} SELECT p_partkey, CASE codec WHEN 'h264' THEN 'h264' WHEN 'hevc' THEN 'h265' WHEN 'aac' THEN 'aac' WHEN 'opus' THEN 'opus' END AS demux_codec,
  CASE codec WHEN 'h264' THEN 'h264' WHEN 'hevc' THEN 'hevc' WHEN 'aac' THEN 'adts' WHEN 'opus' THEN 'opus' END AS demux_format,
  CASE lower(codec) WHEN 'h265' THEN 'hevc' WHEN 'raw' THEN 'data' WHEN 'vp9' THEN NULL ELSE lower(codec) END AS mux_format FROM f"""
)
def codec_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detect.demux_parameters(F.col("codec"))
    return _track_facts(spark, sf_dir).select("p_partkey", d["codec"].alias("demux_codec"), d["format"].alias("demux_format"), detect.mux_format(F.col("codec")).alias("mux_format"))


@query(
    """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN b & 31 ELSE (b >> 1) & 63 END AS nal_type, CASE WHEN user_id % 2 = 0 THEN b & 31 = 5 ELSE (b >> 1) & 63 IN (19, 20) END AS is_idr,
  CASE WHEN user_id % 2 = 0 THEN b & 31 BETWEEN 1 AND 5 ELSE (b >> 1) & 63 <= 31 END AS is_slice FROM (SELECT *, (event_id % 256)::INT AS b FROM events)"""
)
def nal_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = F.when(F.col("user_id") % 2 == 0, "h264").otherwise("h265")
    k = codec_facts.nal_kind((F.col("event_id") % 256).cast("int"), codec)
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).select("event_id", F.col("k.type").alias("nal_type"), "k.is_idr", "k.is_slice")


@query(
    """SELECT user_id, CASE WHEN len(list_filter(f, lambda b: (b >> 1) & 63 IN (1, 19, 20, 32, 33, 34))) > len(list_filter(f, lambda b: b & 31 IN (1, 5, 7, 8))) THEN 'h265' ELSE 'h264' END AS codec
  FROM (SELECT user_id, list((event_id % 256)::INT ORDER BY event_id)[1:10] AS f FROM events GROUP BY user_id)"""
)
def codec_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = F.transform(F.sort_array(F.collect_list("event_id")), lambda e: (e % 256).cast("int"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(firsts.alias("f")).select("user_id", codec_facts.codec_vote(F.col("f")).alias("codec"))


@query(
    f"""SELECT p_partkey, lower(printf('%04x', (((p_size % 5) + 1) << 11) | ((p_partkey % 13)::INT << 7) | ((p_size % 8) << 3))) AS aac_config, {[96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]}[p_partkey % 13 + 1] AS adts_rate,
  CASE WHEN c = 1 THEN 192 WHEN c BETWEEN 2 AND 5 THEN 144 << c WHEN c >= 8 THEN 1 << c END::BIGINT AS flac_block,
  CASE WHEN c = 0 THEN 44100 WHEN c BETWEEN 1 AND 11 THEN [88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000][c] END::BIGINT AS flac_rate FROM (SELECT *, (p_partkey % 16)::INT AS c FROM part)"""
)
def codec_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    code = (key % 16).cast("int")
    return table(spark, sf_dir, "part").select(
        "p_partkey", codec_facts.aac_config(size % 5 + 1, (key % 13).cast("int"), size % 8).alias("aac_config"), codec_facts.adts_rate((key % 13).cast("int")).alias("adts_rate"),
        codec_facts.flac_block_size(code).alias("flac_block"), codec_facts.flac_rate(code, F.lit(44100)).alias("flac_rate"),
    )


@query("SELECT l_orderkey, sum(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE (l_partkey * 1000000) // (l_linenumber % 3 * 22050) END)::BIGINT AS us FROM lineitem GROUP BY l_orderkey")
def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = timecode.samples_to_us(F.col("l_partkey"), F.col("l_linenumber") % 3 * 22050)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(us).alias("us"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey * 7 END AS rate, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_size % 8)::BIGINT END AS channels,
  replace(p_name, 'a', '') AS stripped FROM part"""
)
def opus_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.col("p_partkey") * 7
    le = lambda c: F.concat(*[F.lpad(F.hex(F.shiftright(c, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)])
    head = F.concat(F.lit("4F67675300" + "4F70757348656164" + "01"), F.lpad(F.hex((F.col("p_size") % 8).cast("bigint")), 2, "0"), F.lit("0000"), le(rate), F.lit("000000"))
    data = F.when(F.col("p_partkey") % 3 != 0, F.unhex(head)).otherwise(F.encode("p_name", "UTF-8"))
    name = F.encode(F.replace("p_name", F.lit("a"), F.lit("\0\0\3")), "ISO-8859-1")
    plain = F.replace(F.decode(codec_facts.without_emulation(name), "ISO-8859-1"), F.lit("\0\0"), F.lit(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", codec_facts.opus_head(data).alias("head"), plain.alias("stripped"))
    return rows.select("p_partkey", "head.rate", "head.channels", "stripped")


# --- timed tracks ---

_EVENT_SQL = """e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS pts,
  strlen(props) AS size, event_type = 'purchase' AS is_idr FROM events)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of a track for each user: pts in microseconds since the user's first event."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    own = Window.partitionBy("user_id")
    return table(spark, sf_dir, "events").select(
        "user_id", (F.row_number().over(own.orderBy("ts", "event_id")) - 1).cast("bigint").alias("frame_index"), (us - F.min(us).over(own)).alias("pts"),
        F.octet_length("props").cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("duration"), (F.col("event_type") == "purchase").alias("is_idr"),
    )


def _grouping_sql(cap: int, longest: int, duration: int, idr: str) -> str:
    return f"""WITH RECURSIVE {_EVENT_SQL}, g(user_id, k, chunk_index, first_frame, pts, size) AS (
  SELECT user_id, k, 0::BIGINT, k, pts, size FROM e WHERE k = 0 UNION ALL
  SELECT user_id, e.k, CASE WHEN stop THEN chunk_index + 1 ELSE chunk_index END, CASE WHEN stop THEN e.k ELSE first_frame END, CASE WHEN stop THEN e.pts ELSE s.pts END, CASE WHEN stop THEN e.size ELSE s.size + e.size END
  FROM (SELECT g.user_id, g.chunk_index, g.first_frame, g.pts, g.size, e.k AS next, g.size + e.size > {cap} OR e.pts + {duration} - g.pts > {longest} OR {idr} AS stop FROM g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1) s
  JOIN e USING (user_id) WHERE e.k = s.next)
SELECT user_id, chunk_index, min(pts) AS pts, min(first_frame) AS first_frame, count(*) AS n_frames, max(size)::BIGINT AS size FROM g GROUP BY user_id, chunk_index"""


@query(_grouping_sql(200, 86_400_000_000, 0, "false"))
def frame_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.group_by_track(_frames(spark, sf_dir), ["user_id"], 200, 86_400_000_000)


@query(_grouping_sql(150, 86_400_000_000, 3_600_000_000, "false"))
def frame_groups_with_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.group_by_track(_frames(spark, sf_dir).withColumn("duration", F.lit(3_600_000_000)), ["user_id"], 150, 86_400_000_000)


@query(_grouping_sql(300, 9_000_000_000_000_000_000, 0, "e.is_idr"))
def unit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.group_by_track(_frames(spark, sf_dir), ["user_id"], 300, None, True)


@query(
    f"""WITH {_EVENT_SQL}, g AS (SELECT *, sum(is_idr::INT) OVER w - first_value(is_idr::INT) OVER w AS chunk_index FROM e WINDOW w AS (PARTITION BY user_id ORDER BY k))
SELECT user_id, chunk_index::BIGINT AS chunk_index, arg_min(pts, k) AS pts, min(k) AS first_frame, count(*) AS n_frames, sum(size)::BIGINT AS size FROM g GROUP BY user_id, chunk_index"""
)
def idr_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.group_at_idr(_frames(spark, sf_dir), ["user_id"])


@query(
    f"""WITH {_EVENT_SQL} SELECT user_id, k AS frame_index, CASE WHEN user_id % 7 = 0 THEN NULL ELSE pts::DOUBLE * 1 / 1000000 END AS seconds,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE floor((pts / 1000.0) * 90000 / 1001)::BIGINT END AS low, CASE WHEN user_id % 7 = 0 THEN NULL ELSE ceil((pts / 1000.0) * 90000 / 1001)::BIGINT END AS high FROM e"""
)
def pts_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    num = lambda n: F.when(F.col("user_id") % 7 == 0, 0).otherwise(n)
    t = F.col("pts") / F.lit(1000.0)
    return _frames(spark, sf_dir).select(
        "user_id", "frame_index", timecode.pts_to_seconds(F.col("pts"), num(1), F.lit(1_000_000)).alias("seconds"),
        timecode.seconds_to_pts_floor(t, num(1001), F.lit(90_000)).alias("low"), timecode.seconds_to_pts_ceil(t, num(1001), F.lit(90_000)).alias("high"),
    )


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).withColumn("pts", F.when(F.col("frame_index") % 5 != 3, F.col("pts"))).select("user_id", F.col("frame_index").alias("chunk_index"), "pts", "is_idr", "size")


_INDEX_SQL = _EVENT_SQL + ", x AS (SELECT user_id, k AS i, CASE WHEN k % 5 <> 3 THEN pts END AS pts, is_idr, size FROM e)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests for each user: a bounded one, and one that is open at one end."""
    users = _index(spark, sf_dir).groupBy("user_id").agg(F.max("pts").alias("m"), F.max("chunk_index").alias("n"))
    both = users.withColumn("open", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.select(
        (F.col("user_id") * 2 + F.col("open")).alias("request_id"), "user_id", F.when(F.col("user_id") % 11 == 0, 0).otherwise(1).alias("timebase_num"), F.lit(1_000_000).alias("timebase_den"),
        F.when((F.col("open") == 0) | (F.col("user_id") % 2 == 0), F.floor(F.col("m") / 4) / F.lit(1e6)).alias("start_time"), F.when((F.col("open") == 0) | (F.col("user_id") % 2 == 1), F.floor(F.col("m") / 2) / F.lit(1e6)).alias("end_time"),
        F.floor(F.col("n") / 4).alias("first_chunk"), (F.floor(F.col("n") / 2) + F.col("open") * 1000).alias("end_chunk"),
    )


_REQUESTS_SQL = (
    _INDEX_SQL
    + """, q AS (SELECT user_id * 2 + o AS request_id, user_id, CASE WHEN user_id % 11 = 0 THEN 0 ELSE 1 END AS num, 1000000 AS den, CASE WHEN o = 0 OR user_id % 2 = 0 THEN (m // 4) / 1e6 END AS s,
  CASE WHEN o = 0 OR user_id % 2 = 1 THEN (m // 2) / 1e6 END AS t, n // 4 AS first_chunk, n // 2 + o * 1000 AS end_chunk FROM (SELECT user_id, max(pts) AS m, max(i) AS n FROM x GROUP BY user_id), (VALUES (0), (1)) v(o))"""
)


@query(
    f"""WITH {_REQUESTS_SQL}, b AS (SELECT q.request_id, q.user_id, num, CASE WHEN s IS NULL THEN lo ELSE floor(s * den / nullif(num, 0))::BIGINT END AS a, CASE WHEN t IS NULL THEN hi + 1 ELSE ceil(t * den / nullif(num, 0))::BIGINT END AS z
  FROM q JOIN (SELECT user_id, min(pts) AS lo, max(pts) AS hi FROM x GROUP BY user_id) USING (user_id)),
r AS (SELECT request_id, num, coalesce(arg_max(i, (pts, i)) FILTER (pts <= a), arg_min(i, (pts, i))) AS f, coalesce(arg_min(i, (pts, i)) FILTER (pts >= z), arg_max(i, (pts, i)) + 1) AS l, any_value(a) AS a, any_value(z) AS z
  FROM b JOIN x USING (user_id) WHERE pts IS NOT NULL GROUP BY request_id, num)
SELECT q.request_id, CASE WHEN r.num <> 0 AND f < l THEN f END AS first_chunk, CASE WHEN r.num <> 0 AND f < l THEN l END AS end_chunk FROM q LEFT JOIN r ON r.request_id = q.request_id"""
)
def time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.time_to_chunks(_requests(spark, sf_dir), _index(spark, sf_dir), ["user_id"])


@query(
    f"""WITH {_REQUESTS_SQL}, r AS (SELECT request_id, num, den, first_chunk, end_chunk, arg_min(pts, i) FILTER (i >= first_chunk) AS a, arg_min(pts, i) FILTER (i >= end_chunk) AS b, arg_max(pts, i) FILTER (i >= first_chunk AND i < end_chunk) AS c
  FROM q JOIN x USING (user_id) WHERE pts IS NOT NULL GROUP BY ALL)
SELECT q.request_id, CASE WHEN r.num <> 0 AND r.first_chunk < r.end_chunk AND coalesce(b, c + r.den // greatest(r.num, 1)) IS NOT NULL THEN a::DOUBLE * r.num / r.den END AS start_time,
  CASE WHEN r.num <> 0 AND r.first_chunk < r.end_chunk AND a IS NOT NULL THEN coalesce(b, c + r.den // greatest(r.num, 1))::DOUBLE * r.num / r.den END AS end_time FROM q LEFT JOIN r ON r.request_id = q.request_id"""
)
def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.chunks_to_time(_requests(spark, sf_dir), _index(spark, sf_dir), ["user_id"])


@query(
    f"WITH {_REQUESTS_SQL} SELECT request_id, CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN 'time' WHEN request_id % 3 = 0 THEN 'index' WHEN s IS NOT NULL OR t IS NOT NULL THEN 'open_time' END AS kind FROM q"
)
def range_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("request_id") % 3 == 0, F.col("end_chunk"))
    return _requests(spark, sf_dir).select("request_id", ranges.range_kind(F.col("start_time"), F.col("end_time"), F.col("first_chunk"), end).alias("kind"))


@query(f"WITH {_REQUESTS_SQL} SELECT request_id, user_id, i AS chunk_index, size FROM q JOIN x USING (user_id) WHERE i >= first_chunk AND i < end_chunk")
def clip_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _requests(spark, sf_dir).select("request_id", "user_id", "first_chunk", "end_chunk")
    return ranges.select_clip(asked, _index(spark, sf_dir), ["user_id"]).select("request_id", "user_id", "chunk_index", "size")


@query(f"WITH {_REQUESTS_SQL} SELECT request_id, user_id, max(i) FILTER (is_idr AND i <= first_chunk) AS idr_chunk FROM q JOIN x USING (user_id) GROUP BY request_id, user_id")
def idr_snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.snap_to_idr(_requests(spark, sf_dir), _index(spark, sf_dir), ["user_id"])


@query(
    f"""WITH {_REQUESTS_SQL}, v AS (SELECT request_id, track, max(i) FILTER (is_idr AND i % 2 = track AND i <= first_chunk) AS idr FROM q JOIN x USING (user_id), (VALUES (0), (1)) t(track) GROUP BY request_id, track)
SELECT q.request_id, least(first_chunk, (SELECT min(idr) FROM v WHERE v.request_id = q.request_id)) AS snapped_start FROM q"""
)
def idr_snaps_across_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _requests(spark, sf_dir)
    per_track = requests.withColumn("track", F.explode(F.array(F.lit(0), F.lit(1))))
    chunks = _index(spark, sf_dir).withColumn("track", (F.col("chunk_index") % 2).cast("int"))
    return ranges.snap_across_tracks(ranges.snap_to_idr(per_track, chunks, ["user_id", "track"]), requests)


# --- proofs against indexes ---

_PROOF_SQL = """l AS (SELECT l_orderkey AS work_id, l_quantity::BIGINT AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS k FROM lineitem),
o AS (SELECT *, sum(size) OVER (PARTITION BY work_id ORDER BY k)::BIGINT - size AS "offset" FROM l)"""


def _line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work_id"), F.col("l_quantity").cast("bigint").alias("size"), (F.row_number().over(along) - 1).cast("bigint").alias("chunk_index"))
    return entries.with_offsets(rows, ["work_id"], ["chunk_index"])


@query(
    f"WITH {_PROOF_SQL} SELECT work_id, k AS chunk_index, CASE WHEN work_id % 3 = 0 THEN \"offset\" WHEN k % 4 = 3 THEN NULL ELSE \"offset\" END AS \"offset\", CASE WHEN work_id % 3 <> 0 AND k % 4 = 3 THEN NULL ELSE size END AS size FROM o"
)
def proof_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with ids divisible by three have no index: their proofs' running sizes count. In the others' indexes every fourth entry lacks."""
    chunks = _line_chunks(spark, sf_dir)
    index = chunks.where("work_id % 3 <> 0 AND chunk_index % 4 <> 3")
    proofs = chunks.select("work_id", "chunk_index", F.col("chunk_index").alias("proof_ord"), F.col("size").alias("chunk_size"))
    return entries.proof_places(proofs, index, ["work_id"]).select("work_id", "chunk_index", "offset", "size")


@query(
    f"WITH {_PROOF_SQL}, u AS (SELECT work_id, sum(size)::BIGINT AS n FROM l GROUP BY work_id) SELECT o_orderkey AS work_id, 100 + coalesce(n, 0) AS consumed, 100 + coalesce(n, 0) + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS file_length, o_orderkey % 10 = 0 AS extra FROM orders LEFT JOIN u ON work_id = o_orderkey"
)
def extra_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _line_chunks(spark, sf_dir)
    proofs = chunks.select("work_id", F.col("size").alias("chunk_size"))
    total = chunks.groupBy("work_id").agg(F.sum("size").alias("n"))
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work_id")).join(total, "work_id", "left")
    length = F.lit(100) + F.coalesce("n", F.lit(0)) + F.when(F.col("work_id") % 10 == 0, 1).otherwise(0)
    return entries.extra_bytes(proofs, files.select("work_id", F.lit(100).cast("bigint").alias("data_start"), length.cast("bigint").alias("file_length")), ["work_id"])


@query("SELECT o_orderkey AS work_id, (CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END + count(l_orderkey))::BIGINT AS expected, count(l_orderkey) AS found FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING o_orderkey % 5 = 0")
def index_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _line_chunks(spark, sf_dir)
    counts = chunks.groupBy("work_id").agg(F.count("*").alias("n"))
    said = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("work_id")).join(counts, "work_id", "left")
    total = F.coalesce("n", F.lit(0)) + F.when(F.col("work_id") % 5 == 0, 1).otherwise(0)
    return entries.index_errors(said.select("work_id", total.alias("total_chunks")), chunks, ["work_id"])


# --- signatures, authors, reports ---

_SIGNATURES_SQL = f"""a AS (SELECT c_nationkey AS work_id, c_custkey AS ord, 'key' || (c_custkey % 40) AS author_id, c_name AS name, lower(c_mktsegment) AS role FROM customer),
s AS (SELECT c_nationkey AS work_id, c_custkey AS ord, CASE WHEN c_custkey % 13 = 0 AND c_nationkey % 4 <> 0 THEN '{TTP}' ELSE 'key' || (c_custkey % 97) END AS public_key, CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' END AS display_name,
  NOT (c_nationkey % 5 = 0 AND c_custkey % 50 = 0) AS valid FROM customer)"""


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        nation.alias("work_id"), key.alias("ord"), F.when((key % 13 == 0) & (nation % 4 != 0), TTP).otherwise(F.concat(F.lit("key"), key % 97)).alias("public_key"),
        F.when(key % 3 == 0, F.concat("c_name", F.lit("!"))).alias("display_name"), (~((nation % 5 == 0) & (key % 50 == 0))).alias("valid"),
    )


def _authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("work_id"), F.col("c_custkey").alias("ord"), F.concat(F.lit("key"), F.col("c_custkey") % 40).alias("author_id"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("role")
    )


@query(f"WITH {_SIGNATURES_SQL} SELECT work_id, count(*) AS n_signatures, bool_and(valid) AS all_valid, bool_or(public_key = '{TTP}') AS has_ttp, bool_and(valid) AND bool_or(public_key = '{TTP}') AS ok FROM s GROUP BY work_id")
def signature_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.signature_policy(_signatures(spark, sf_dir), ["work_id"], TTP)


@query(f"WITH {_SIGNATURES_SQL} SELECT work_id, sha256(string_agg(author_id || name || role, '' ORDER BY ord)) AS fingerprint, sha256('clip' || work_id) AS derivative FROM a GROUP BY work_id")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _authors(spark, sf_dir).groupBy("work_id").agg(F.sort_array(F.collect_list(F.struct("ord", "author_id", "name", "role"))).alias("authors"))
    return own.select("work_id", policy.authorship_fingerprint(F.col("authors")).alias("fingerprint"), policy.derivative_fingerprint(F.concat(F.lit("clip"), "work_id")).alias("derivative"))


@query(
    f"""WITH {_SIGNATURES_SQL}, k AS (SELECT work_id, author_id, arg_min(name, ord) AS name FROM a GROUP BY ALL)
SELECT s.work_id, s.ord, CASE WHEN public_key = '{TTP}' THEN coalesce(display_name, 'Trusted Third Party') ELSE coalesce(k.name, display_name, 'Author Key') END AS label FROM s LEFT JOIN k ON k.work_id = s.work_id AND k.author_id = s.public_key"""
)
def signature_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.signature_labels(_signatures(spark, sf_dir), _authors(spark, sf_dir), ["work_id"], TTP).select("work_id", "ord", "label")


@query(
    f"""WITH {_SIGNATURES_SQL}, n AS (SELECT * FROM s WHERE trim(display_name) <> ''), t AS (SELECT work_id, arg_min(display_name, ord) AS own FROM n WHERE public_key = '{TTP}' GROUP BY work_id),
o AS (SELECT work_id, count(DISTINCT display_name) AS c, min(display_name) AS sole FROM n WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.work_id = n.work_id AND a.name = n.display_name) GROUP BY work_id)
SELECT w.work_id, coalesce(t.own, CASE WHEN c = 1 THEN sole END, 'Trusted Third Party') AS ttp_name FROM (SELECT DISTINCT work_id FROM s) w LEFT JOIN t ON t.work_id = w.work_id LEFT JOIN o ON o.work_id = w.work_id"""
)
def ttp_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.ttp_display_name(_signatures(spark, sf_dir), _authors(spark, sf_dir), ["work_id"], TTP)


@query(f"WITH {_SIGNATURES_SQL} SELECT work_id, string_agg(name, ', ' ORDER BY ord) AS names, count(*) AS n_authors FROM a GROUP BY work_id")
def author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = _authors(spark, sf_dir)
    return policy.name_list(authors, ["work_id"], "name", "ord").join(authors.groupBy("work_id").agg(F.count("*").alias("n_authors")), "work_id")


@query(
    """SELECT c_custkey, concat_ws('; ', CASE WHEN c_custkey % 2 = 0 THEN 'manifest hash' END, CASE WHEN c_acctbal < 0 THEN 'content hash' END, CASE WHEN c_custkey % 5 = 0 THEN 'work id' END) AS mismatch,
  CASE WHEN c_custkey % 5 = 0 THEN 'w' || c_custkey WHEN c_custkey % 3 = 0 THEN 'o' || c_custkey END AS work_id FROM customer"""
)
def metadata_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    tags = F.map_from_arrays(
        F.array_compact(F.array(F.when(key % 5 == 0, "SMED.Work_Id"), F.when(key % 3 == 0, "smed.original_work_id"))), F.array_compact(F.array(F.when(key % 5 == 0, F.concat(F.lit("w"), key)), F.when(key % 3 == 0, F.concat(F.lit("o"), key))))
    )
    bad = policy.mismatches([(key % 2 != 0, "manifest hash"), (F.col("c_acctbal") >= 0, "content hash"), (key % 5 != 0, "work id")])
    return table(spark, sf_dir, "customer").select("c_custkey", bad.alias("mismatch"), policy.work_id_tag(tags, "derivative_id").alias("work_id"))


@query(
    """WITH RECURSIVE e AS (SELECT conv_id * 1000 + turn AS child, conv_id * 1000 + turn - 1 AS parent FROM conversations WHERE turn > 0), u(child, ancestor, depth) AS (
  SELECT child, parent, 1::BIGINT FROM e UNION ALL SELECT u.child, e.parent, depth + 1 FROM u JOIN e ON e.child = u.ancestor) SELECT child, ancestor, depth FROM u"""
)
def ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("turn > 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("child")).withColumn("parent", F.col("child") - 1)
    return policy.ancestry(turns)


@query("SELECT conv_id, string_agg(turn::VARCHAR, ' -> ' ORDER BY turn) AS chain FROM conversations GROUP BY conv_id")
def ancestry_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (-F.col("turn")).alias("depth"))
    return policy.chain_print(turns, ["conv_id"], "turn", "depth")


@query(
    """SELECT s_suppkey, lower(hex(encode(s_name))) AS hexed, to_base64(encode(s_name)) AS encoded, lower(s_name) AS folded, nullif(trim(CASE WHEN s_suppkey % 4 = 0 THEN '  ' ELSE ' ' || s_name || ' ' END), '') AS cleaned FROM supplier"""
)
def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("s_name", "UTF-8")
    padded = F.when(F.col("s_suppkey") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "s_name", F.lit(" ")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.lower(F.hex(data)).alias("hexed"), F.base64(data).alias("encoded"), F.lower("s_name").alias("folded"), policy.clean_name(padded).alias("cleaned"))


# --- whole works ---

#: Keys for tests and examples; a real signer is passed in by the caller.
SIGNERS = manifests.Signers(SigningKey(bytes(range(32))), SigningKey(bytes(32)), "Example Author")
TTP_KEY = SIGNERS.ttp.public_key().hex()
WORKS_SQL = "n AS (SELECT source AS work_id, doc_id, (strlen(text) + 4095) // 4096 AS k FROM documents WHERE strlen(text) > 0)"


def signed_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One work for each source, with its documents as opaque tracks."""
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("work_id"), F.col("doc_id").alias("input_ord"), F.encode("text", "UTF-8").alias("data"))
    signed, chunks = works.sign(files, SIGNERS, cap=4096)
    return written(signed, "manifests"), chunks  # the chunks stand in a written table already


@query(f"WITH {WORKS_SQL} SELECT work_id, count(*) AS n_tracks, sum(k)::BIGINT AS n_chunks, true AS ok, 0::BIGINT AS n_failures, false AS tampered_ok FROM n GROUP BY work_id")
def signed_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works are signed and verified; each fails once a byte of its first chunk changes."""
    signed, chunks = signed_sources(spark, sf_dir)
    key = SIGNERS.ttp.public_key().hex()
    first = (F.col("track_id") == 0) & (F.col("chunk_index") == 0)
    tampered = chunks.withColumn("data", F.when(first, F.concat(F.lit(b"\0"), F.substring("data", 2, 1 << 30))).otherwise(F.col("data")))
    verdict = works.verify(signed, chunks, key).select("work_id", "ok", F.size("failures").cast("bigint").alias("n_failures"))
    counts = chunks.groupBy("work_id").agg(F.countDistinct("track_id").alias("n_tracks"), F.count("*").alias("n_chunks"))
    return counts.join(verdict, "work_id").join(works.verify(signed, tampered, key).select("work_id", F.col("ok").alias("tampered_ok")), "work_id")


@query(f"WITH {WORKS_SQL} SELECT work_id, 'Original' AS kind, 'Untitled' AS title, 1::BIGINT AS n_authors, count(*) AS n_tracks, 2::BIGINT AS n_signatures, 0::BIGINT AS n_ancestors, 0::BIGINT AS n_mappings, '' AS mismatches FROM n GROUP BY work_id")
def work_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports, and the tags of extracted files checked against the manifests they hold."""
    signed, _ = signed_sources(spark, sf_dir)
    tagged = works.verify_metadata(works.tags(signed, SIGNERS.ttp.public_key().hex())).select("work_id", "mismatches")
    return works.report(signed).join(tagged, "work_id")


@query(f"WITH {WORKS_SQL} SELECT work_id, count(*) AS n_tracks, 0::BIGINT AS n_bytes, 'passthrough' AS mode, CASE WHEN count(*) > 1 THEN 'a raw track can''t be muxed with others' ELSE 'the extension doesn''t fit the raw track''s type' END AS error FROM n GROUP BY work_id")
def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opaque tracks without a known type can't be extracted; every one is refused for the same reason."""
    signed, chunks = signed_sources(spark, sf_dir)
    out = works.extract(signed, chunks, "mp4")
    return out.groupBy("work_id").agg(F.count("*").alias("n_tracks"), F.sum(F.coalesce(F.octet_length("data"), F.lit(0))).cast("bigint").alias("n_bytes"), F.min("mode").alias("mode"), F.min("error").alias("error"))


def signed_audio(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A work for each user: an AAC track with one frame for each event, whose payload is the event's properties."""
    size = F.octet_length("props") + 7
    length = size.cast("bigint")
    head = F.concat(
        F.lit("FFF150"), F.lpad(F.hex(F.lit(0x80).cast("bigint").bitwiseOR(F.shiftright(length, 11))), 2, "0"), F.lpad(F.hex(F.shiftright(length, 3).bitwiseAND(F.lit(255))), 2, "0"),
        F.lpad(F.hex(F.shiftleft(length.bitwiseAND(F.lit(7)), 5).bitwiseOR(F.lit(31))), 2, "0"), F.lit("FC"),
    )
    frames = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("work_id"), F.struct("ts", "event_id", F.concat(head, F.hex(F.encode("props", "UTF-8"))).alias("h")).alias("f"))
    files = frames.groupBy("work_id").agg(F.unhex(F.array_join(F.sort_array(F.collect_list("f"))["h"], "")).alias("data"))
    signed, chunks = works.sign(files.withColumn("input_ord", F.lit(0)), SIGNERS, cap=1 << 20)
    return written(signed, "manifests"), chunks  # the chunks stand in a written table already


@query(
    """WITH n AS (SELECT user_id::VARCHAR AS work_id, count(*) AS frames FROM events GROUP BY user_id), c AS (SELECT work_id, (frames + 42) // 43 AS n_chunks FROM n)
SELECT 'clip-' || work_id AS work_id, least(2, n_chunks) AS n_chunks, true AS ok, least(2, n_chunks) AS n_streamed FROM c"""
)
def clipped_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two chunks of every audio work (43 frames of 1024 samples fit a second) are cut out, signed, verified, and verified chunk by chunk."""
    signed, chunks = signed_audio(spark, sf_dir)
    n = chunks.groupBy("work_id").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("double")
    requests = n.select(F.col("work_id").alias("request_id"), F.concat(F.lit("clip-"), "work_id").alias("derivative_id"), "work_id", F.lit(0).cast("bigint").alias("track_id"), none.alias("start_time"), none.alias("end_time"), F.lit(0).cast("bigint").alias("start_chunk"), F.lit(2).cast("bigint").alias("end_chunk"))
    clips, parts, _ = works.clip(signed, chunks, written(requests, "requests"), SIGNERS)
    clips, parts = written(clips, "clips"), written(parts, "clip-chunks")
    verdict = works.verify(clips, parts, SIGNERS.ttp.public_key().hex()).select("work_id", "ok")
    streamed = verifier.verify_chunks(parts, clips).groupBy("work_id").agg(F.sum(F.col("valid").cast("bigint")).alias("n_streamed"), F.count("*").alias("n_chunks"))
    return verdict.join(streamed, "work_id")


@query(
    """SELECT user_id::VARCHAR AS work_id, 'elementary' AS mode, sum(n)::BIGINT AS n_bytes, NULL::VARCHAR AS error,
  sha256(unhex(string_agg(printf('FFF150%02X%02X%02XFC', 128 | (n >> 11), (n >> 3) & 255, ((n & 7) << 5) | 31) || hex(encode(props)), '' ORDER BY ts, event_id))) AS hash
FROM (SELECT *, strlen(props) + 7 AS n FROM events) GROUP BY user_id"""
)
def audio_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every audio work is extracted whole: its chunks in order are the frames of its events."""
    signed, chunks = signed_audio(spark, sf_dir)
    return works.extract(signed, chunks, "mp4").select("work_id", "mode", F.octet_length("data").cast("bigint").alias("n_bytes"), "error", F.sha2("data", 256).alias("hash"))


#: Kind, start and end in seconds, start and end chunk.
_RANGES = (("time", 1.0, 1.5, None, None), ("index", None, None, 1, 3), ("open", 1.0, None, None, None))


@query(
    """WITH n AS (SELECT user_id::VARCHAR AS work_id, count(*) AS frames FROM events GROUP BY user_id), c AS (SELECT work_id, (frames + 42) // 43 AS n FROM n),
r AS (SELECT 'time-' || work_id AS work_id, least(1, n - 1) AS first_chunk, least(2, n) AS end_chunk FROM c
  UNION ALL SELECT 'index-' || work_id, 1, least(3, n) FROM c WHERE n > 1 UNION ALL SELECT 'open-' || work_id, least(1, n - 1), n FROM c)
SELECT work_id, first_chunk, end_chunk - first_chunk AS n_chunks, true AS ok, end_chunk - first_chunk AS n_streamed FROM r"""
)
def later_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of every audio work that begin after its first chunk (43 frames of 23,219 microseconds), by times, by chunks, and from a time on."""
    signed, chunks = signed_audio(spark, sf_dir)
    asked = spark.createDataFrame(_RANGES, "kind string, start_time double, end_time double, start_chunk bigint, end_chunk bigint")
    requests = chunks.select("work_id").distinct().crossJoin(F.broadcast(asked)).withColumn("request_id", F.concat_ws("-", "kind", "work_id"))  # broadcast: three rows
    requests = requests.select("request_id", F.col("request_id").alias("derivative_id"), "work_id", F.lit(0).cast("bigint").alias("track_id"), "start_time", "end_time", "start_chunk", "end_chunk")
    clips, parts, _ = works.clip(signed, chunks, written(requests, "requests"), SIGNERS)
    clips, parts = written(clips, "clips"), written(parts, "clip-chunks")
    verdict = works.verify(clips, parts, SIGNERS.ttp.public_key().hex()).select("work_id", "ok")
    streamed = verifier.verify_chunks(parts, clips).groupBy("work_id").agg(F.sum(F.col("valid").cast("bigint")).alias("n_streamed"), F.count("*").alias("n_chunks"))
    first = parts.groupBy("work_id").agg(F.min("chunk_index").cast("bigint").alias("first_chunk"))
    return verdict.join(streamed, "work_id").join(first, "work_id")


from mediastrata.plans import media_queries  # noqa: E402, F401  registers its queries; it needs what stands above
