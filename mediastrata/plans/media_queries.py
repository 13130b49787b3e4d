"""Registered queries of parsers, containers, known answers, and of requests and files that fail, each with its DuckDB SQL.

Streams and containers are built byte by byte from the driver's tables; the SQL knows what was built, not how it is parsed.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediastrata.functions import canonical, detect, ed25519, hashing, keys
from mediastrata.operators import entries
from mediastrata.plans import registry, works
from mediastrata.sources import container, media
from mediastrata.sources.staging import fresh_path, written
from mediastrata.streaming import verifier

query, table = registry.query, registry.table


def _hex(c: Column, digits: int) -> Column:
    """A number as so many hex digits, most significant first."""
    return F.lpad(F.hex(c.cast("bigint")), digits, "0")


def _little(c: Column, size: int) -> Column:
    """A number as hex of so many bytes, least significant first."""
    whole = _hex(c, 2 * size)
    return F.concat(*[F.substring(whole, 2 * k + 1, 2) for k in reversed(range(size))])


def _text(c: str) -> Column:
    return F.hex(F.encode(c, "UTF-8"))


def _streams(spark: SparkSession, sf_dir: str, head: str, unit: Column) -> DataFrame:
    """(user_id, data): for each user a head, then one unit (hex, of k, props and event_type) for each event in order."""
    along = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(along).cast("bigint") - 1).select("user_id", "k", unit.alias("unit"))
    own = events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("k", "unit"))).alias("u"))
    return own.select("user_id", F.unhex(F.concat(F.lit(head), F.array_join("u.unit", ""))).alias("data"))


_E = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, strlen(props) AS n, event_type FROM events)"
_ALONG = "(PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

# --- parsers ---


@query(
    f"""WITH {_E} SELECT user_id, k AS frame_index, coalesce(sum(n + 7) OVER {_ALONG}, 0)::BIGINT AS start, n + 7 AS length, k * (1024 * 1000000 // 44100) AS pts, 1024 * 1000000 // 44100 AS duration,
  44100 AS sample_rate, 2 AS channels, '1210' AS extradata, 'aac' AS codec FROM e"""
)
def adts_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.octet_length("props") + 7).cast("bigint")
    length = F.concat(_hex(F.lit(0x80).bitwiseOR(F.shiftright(n, 11)), 2), _hex(F.shiftright(n, 3).bitwiseAND(F.lit(255)), 2), _hex(F.shiftleft(n.bitwiseAND(F.lit(7)), 5).bitwiseOR(F.lit(31)), 2))
    files = _streams(spark, sf_dir, "", F.concat(F.lit("FFF150"), length, F.lit("FC"), _text("props")))
    return media.frames(files, ["user_id"], "adts").drop("is_idr")


@query(
    f"""WITH {_E}, p AS (SELECT user_id, -1 AS k, 47 AS length, 0 AS granule FROM (SELECT DISTINCT user_id FROM e) UNION ALL
  SELECT user_id, k, 28 + n, CASE WHEN k % 4 = 3 THEN NULL ELSE 960 * k + 960 - CASE WHEN k % 5 = 4 THEN 2000 ELSE 0 END END FROM e),
g AS (SELECT *, last_value(granule IGNORE NULLS) OVER {_ALONG} AS earlier FROM p), l AS (SELECT *, coalesce(greatest(granule - earlier, 0), 0) AS lasts FROM g)
SELECT user_id, k + 1 AS frame_index, coalesce(sum(length) OVER {_ALONG}, 0)::BIGINT AS start, length, (coalesce(sum(lasts) OVER {_ALONG}, 0) * 1000000 // 48000)::BIGINT AS pts, lasts * 1000000 // 48000 AS duration,
  44100 AS sample_rate, 2 AS channels FROM l"""
)
def ogg_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identification header, then a page for each event; every fourth granule isn't known, some fall back."""
    page = "4F67675300" + "00" + "{}" + "00" * 12 + "01"
    head = page.format("00" * 8) + "13" + "4F70757348656164" + "0102" + "3801" + "44AC0000" + "000000"
    k = F.col("k")
    granule = F.when(k % 4 == 3, F.lit("FF" * 8)).otherwise(_little(960 * k + 960 - F.when(k % 5 == 4, 2000).otherwise(0), 8))
    before, after = page.split("{}")
    files = _streams(spark, sf_dir, head, F.concat(F.lit(before), granule, F.lit(after), _hex(F.octet_length("props"), 2), _text("props")))
    return media.frames(files, ["user_id"], "opus").drop("is_idr", "codec", "extradata")


def _crc8(data: Column) -> Column:
    """The CRC-8 (x^8 + x^2 + x + 1) of hex, as two digits."""
    byte = lambda i: F.conv(F.substr(data, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    shift = lambda c, _: F.shiftleft(c, 1).bitwiseXOR(F.when(c.bitwiseAND(F.lit(128)) != 0, 0x107).otherwise(0))
    crc = F.aggregate(F.sequence(F.lit(0), (F.length(data) / 2 - 1).cast("int")), F.lit(0), lambda c, i: F.aggregate(F.sequence(F.lit(1), F.lit(8)), c.bitwiseXOR(byte(i)), shift))
    return _hex(crc, 2)


@query(
    f"""WITH {_E}, f AS (SELECT user_id, -1 AS k, 42 AS length, 0 AS samples FROM (SELECT DISTINCT user_id FROM e) UNION ALL
  SELECT user_id, k, n + CASE WHEN k % 2048 < 128 THEN 6 ELSE 7 END, 144 << (2 + k % 4) FROM e)
SELECT user_id, k + 1 AS frame_index, coalesce(sum(length) OVER {_ALONG}, 0)::BIGINT AS start, length, (coalesce(sum(samples) OVER {_ALONG}, 0) * 1000000 // 44100)::BIGINT AS pts, samples * 1000000 // 44100 AS duration,
  44100 AS sample_rate, 2 AS channels FROM f"""
)
def flac_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's metadata is its first frame; the others have four block sizes, and numbers of one or two bytes."""
    head = "664C6143" + "80000022" + "10001000" + "000000000000" + "0AC442F000000000" + "00" * 16
    number = F.col("k") % 2048
    coded = F.when(number < 128, _hex(number, 2)).otherwise(F.concat(_hex(F.shiftright(number, 6).bitwiseOR(F.lit(0xC0)), 2), _hex(number.bitwiseAND(F.lit(63)).bitwiseOR(F.lit(0x80)), 2)))
    header = F.concat(F.lit("FFF8"), _hex((2 + F.col("k") % 4) * 16 + F.when(F.col("k") % 2 == 0, 9).otherwise(0), 2), F.lit("18"), coded)
    files = _streams(spark, sf_dir, head, F.concat(header, _crc8(header), _text("props")))
    return media.frames(files, ["user_id"], "flac").drop("is_idr", "codec", "extradata")


@query(
    f"""WITH {_E}, u AS (SELECT user_id, -2 AS k, 6 AS length, false AS idr, false AS slice FROM (SELECT DISTINCT user_id FROM e) UNION ALL SELECT user_id, -1, 6, false, false FROM (SELECT DISTINCT user_id FROM e) UNION ALL
  SELECT user_id, k, n + 4 + (k + 1) % 2, event_type = 'purchase', event_type = 'purchase' OR k % 3 = 0 FROM e)
SELECT user_id, k + 2 AS frame_index, 2 + coalesce(sum(length) OVER {_ALONG}, 0)::BIGINT AS start, length, coalesce(sum(slice::INT) OVER {_ALONG}, 0)::BIGINT AS pts, idr AS is_idr, 'h264' AS codec,
  '000000016742000000016870' AS extradata FROM u"""
)
def annexb_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bytes before the first code are dropped; parameter sets, then a unit for each event, with codes of four bytes or three."""
    kind = F.when(F.col("event_type") == "purchase", "65").when(F.col("k") % 3 == 0, "41").otherwise("06")
    files = _streams(spark, sf_dir, "4142" + "000000016742" + "000000016870", F.concat(F.when(F.col("k") % 2 == 0, "00000001").otherwise("000001"), kind, _text("props")))
    return media.frames(files, ["user_id"], "annexb").drop("duration", "sample_rate", "channels")


def _ue(n: Column) -> Column:
    b = F.bin((n + 1).cast("bigint"))
    return F.concat(F.repeat(F.lit("0"), F.length(b) - 1), b)


@query(
    """SELECT p_partkey, 16 * w - CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 0 END AS width, 16 * h * f - CASE WHEN p_partkey % 7 = 0 THEN 4 * f ELSE 0 END AS height,
  CASE WHEN p_partkey % 4 <> 1 THEN 2 * (1001 + p_size) END AS timebase_num, CASE WHEN p_partkey % 4 <> 1 THEN 60000 END AS timebase_den
FROM (SELECT *, 1 + p_partkey % 120 AS w, 1 + p_size AS h, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END AS f FROM part)"""
)
def parameter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline and high profiles, a scaling list, fields, cropping, and timing, written bit by bit with emulation prevention."""
    key, one, zero = F.col("p_partkey"), F.lit("1"), F.lit("0")
    bits = lambda c, n: F.lpad(F.bin(c.cast("bigint")), n, "0")
    profile = F.when(key % 2 == 0, 66).otherwise(100)
    lists = F.when(key % 3 == 0, F.concat(one, one, _ue(F.lit(16)), F.repeat(zero, F.lit(7)))).otherwise(zero)
    high = F.when(key % 2 == 0, "").otherwise(F.concat(_ue(F.lit(1)), _ue(F.lit(0)), _ue(F.lit(0)), zero, lists))
    fields = F.when(key % 5 == 0, F.lit("00")).otherwise(one)
    crop = F.when(key % 7 == 0, F.concat(one, _ue(F.lit(0)), _ue(F.lit(1)), _ue(F.lit(0)), _ue(F.lit(2)))).otherwise(zero)
    timing = F.when(key % 4 != 1, F.concat(one, F.lit("0000"), one, bits(1001 + F.col("p_size"), 32), bits(F.lit(60_000), 32), one)).otherwise(zero)
    body = F.concat(
        bits(profile, 8), F.lit("00000000" + "00011110"), _ue(F.lit(0)), high, _ue(F.lit(0)), _ue(F.lit(0)), _ue(F.lit(0)), _ue(F.lit(1)), zero,
        _ue(key % 120), _ue(F.col("p_size")), fields, one, crop, timing, one,
    )
    padded = F.call_function("rpad", body, (F.ceil(F.length(body) / 8) * 8).cast("int"), F.lit("0"))
    made = table(spark, sf_dir, "part").select("p_partkey", padded.alias("bits"))
    octets = F.transform(F.sequence(F.lit(1), F.length("bits"), F.lit(8)), lambda i: F.lpad(F.conv(F.substr("bits", i, F.lit(8)), 2, 16), 2, "0"))
    plain = F.decode(F.unhex(F.array_join(octets, "")), "ISO-8859-1")
    escaped = F.encode(F.regexp_replace(plain, "\0\0(?=[\0-\3])", "\0\0\3"), "ISO-8859-1")
    sps = F.unhex(F.concat(F.lit("67"), F.hex(escaped)))
    return made.select("p_partkey", media.parameter_set(sps).alias("p")).select("p_partkey", "p.*")


_DISPATCH = ("h264", "H265", "hevc", "aac", "opus", "FLAC", "raw", "vp9")


@query(
    f"""SELECT p_partkey, codec, i AS chunk_index, least(8, n - 8 * i) AS size FROM (SELECT *, unnest(range(0, (n + 7) // 8)) AS i FROM
  (SELECT p_partkey, lower({list(_DISPATCH)}[p_partkey % 8 + 1]) AS codec, strlen(p_name) AS n FROM part) WHERE codec NOT IN ('raw', 'vp9'))"""
)
def codec_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demuxed tracks whose bytes aren't what their codec says keep its name and are cut into runs; other codecs have no rows."""
    codec = F.get(F.array(*map(F.lit, _DISPATCH)), (F.col("p_partkey") % 8).cast("int"))
    files = table(spark, sf_dir, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("data"), codec.alias("c"))
    return media.chunk_tracks(files, ["p_partkey"], codec_col="c", cap=8).select("p_partkey", "codec", "chunk_index", F.octet_length("data").cast("bigint").alias("size"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS input_ord, i AS chunk_index, upper(hex(substr(t, 8 * i + 1, 8)::BLOB)) AS chunk
FROM (SELECT *, unnest(range(0, (strlen(t) + 7) // 8)) AS i FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_name END AS t FROM part))"""
)
def first_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two inputs the first that has any bytes."""
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 4 != 0, F.encode("p_name", "UTF-8")).otherwise(F.lit(b""))
    files = part.select("p_partkey", F.lit(0).cast("bigint").alias("input_ord"), name.alias("data"))
    files = files.unionByName(part.select("p_partkey", F.lit(1).cast("bigint").alias("input_ord"), F.encode("p_type", "UTF-8").alias("data")))
    chunks = media.chunk_tracks(files, ["p_partkey", "input_ord"], cap=8)
    return media.first_track(chunks, ["p_partkey"]).select("p_partkey", "input_ord", "chunk_index", F.hex("data").alias("chunk"))


@query(
    f"""WITH s AS (SELECT p_partkey // 5 AS file, p_partkey AS i, ['video', 'audio', 'subtitle', 'audio', 'data'][p_partkey % 5 + 1] AS kind, {list(_DISPATCH)}[p_size % 8 + 1] AS codec FROM part)
SELECT file, i AS "index", codec, row_number() OVER (PARTITION BY file ORDER BY i) - 1 AS track_ord FROM s WHERE kind IN ('video', 'audio') AND codec IN ('h264', 'hevc', 'h265', 'aac', 'opus', 'flac')"""
)
def demuxable_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    kind = F.get(F.array(*map(F.lit, ("video", "audio", "subtitle", "audio", "data"))), (key % 5).cast("int"))
    codec = F.get(F.array(*map(F.lit, _DISPATCH)), (F.col("p_size") % 8).cast("int"))
    streams = table(spark, sf_dir, "part").select(F.floor(key / 5).alias("file"), key.alias("index"), kind.alias("codec_type"), codec.alias("codec_name"))
    return detect.demuxable(streams, ["file"]).select("file", "index", F.col("codec_name").alias("codec"), "track_ord")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'second' ELSE 'only' END AS kind, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 2 END AS n FROM customer")
def embedded_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's tags with lower-case keys; where two then are one, the last counts."""
    tags = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("Kind"), F.lit("first"), F.lit("NAME"), F.col("c_name"), F.lit("KIND"), F.lit("second"))).otherwise(
        F.create_map(F.lit("kind"), F.lit("only"), F.lit("Name"), F.col("c_name"))
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", detect.lower_tags(tags).alias("t"))
    return rows.select("c_custkey", F.col("t")["kind"].alias("kind"), F.col("t")["name"].alias("name"), F.size("t").alias("n"))


# --- containers ---


@query(
    """WITH f AS (SELECT p_partkey, p_partkey % 10 AS v, '{"k":' || p_partkey || '}' AS m, strlen('{"k":' || p_partkey || '}') AS ml, strlen(p_name) AS n FROM part)
SELECT p_partkey, CASE WHEN v < 6 THEN CASE WHEN v = 0 THEN 1 ELSE 2 END END AS version, CASE WHEN v < 6 THEN m END AS manifest,
  CASE v WHEN 0 THEN 16 + ml WHEN 1 THEN 32 + ml WHEN 2 THEN 20 WHEN 3 THEN 32 + ml + 15 + 14 WHEN 4 THEN 46 + ml WHEN 5 THEN 32 + ml END AS data_start, CASE WHEN v < 6 THEN n END AS data_length,
  CASE v WHEN 6 THEN 'Missing track data section' WHEN 7 THEN 'Missing manifest section' WHEN 8 THEN 'Invalid magic: expected [83, 77, 69, 68], got [88, 88, 88, 88]' WHEN 9 THEN 'Unsupported version' END AS error FROM f"""
)
def container_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions; sections in another order, unknown, or repeated; stray bytes; and files that are no containers."""
    part = table(spark, sf_dir, "part").withColumn("m", F.format_string('{"k":%d}', "p_partkey"))
    v, manifest, data = F.col("p_partkey") % 10, _text("m"), _text("p_name")
    section = lambda kind, body: F.concat(_little(F.lit(kind), 4), _little(F.length(body) / 2, 8), body)
    two, empty, m, d = F.lit("534D4544" + "02000000"), F.lit("7B7D"), section(1, manifest), section(2, data)
    layouts = [
        F.concat(F.lit("534D4544" + "01000000"), _little(F.length(manifest) / 2, 8), manifest, data), F.concat(two, m, d), F.concat(two, d, m), F.concat(two, m, section(9, F.lit("ABCDEF")), section(5, F.lit("0102")), d),
        F.concat(two, section(1, empty), m, d), F.concat(two, m, d, F.lit("AABBCC")), F.concat(two, m), F.concat(two, d), F.concat(F.lit("58585858"), m), F.concat(F.lit("534D4544" + "03000000"), m, d),
    ]
    files = part.select(F.col("p_partkey").cast("string").alias("path"), F.unhex(F.get(F.array(*layouts), v.cast("int"))).alias("data"))
    good = container.parse_files(files, "manifests", mode="permissive").select("path", "version", "manifest", "data_start", "data_length")
    every = good.unionByName(container.parse_files(files, "errors"), allowMissingColumns=True)
    return every.withColumn("p_partkey", F.col("path").cast("bigint")).drop("path")


_TRACKS_OF_SOURCES = """t AS (SELECT source, doc_id, hex(encode(text)) AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS track_id FROM documents WHERE strlen(text) > 0),
c AS (SELECT source, track_id, i AS chunk_index, substr(h, 8192 * i + 1, 8192) AS x FROM (SELECT *, unnest(range(0, (len(h) // 2 + 4095) // 4096)) AS i FROM t))"""


@query(
    f"""WITH {_TRACKS_OF_SOURCES} SELECT source AS work_id, track_id, chunk_index, sum(len(x) // 2) OVER (PARTITION BY source ORDER BY track_id, chunk_index)::BIGINT - len(x) // 2 AS "offset", len(x) // 2 AS size,
  sha256(unhex(x)) AS hash FROM c"""
)
def container_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed works go through the sink and are read back by the source: every chunk stands where it should."""
    container.register(spark)
    path = fresh_path(spark, "containers")
    works.containers(*registry.signed_sources(spark, sf_dir), "concat(hex(work_id), '.smed')").write.format("provenance").mode("append").save(path)
    chunks = spark.read.format("provenance").option("table", "chunks").load(path)
    work = F.decode(F.unhex(F.regexp_extract("path", r"([0-9A-F]+)\.smed$", 1)), "UTF-8")
    return chunks.select(work.alias("work_id"), "track_id", "chunk_index", "offset", "size", F.sha2("data", 256).alias("hash"))


@query("SELECT p_partkey, CASE WHEN o < 0 OR s < 0 THEN 'Invalid range' WHEN o + s > n THEN 'Requested data outside of track data section' END AS error, CASE WHEN o >= 0 AND s >= 0 AND o + s <= n THEN upper(hex(substr(p_name, o::INT + 1, s::INT)::BLOB)) END AS chunk, CASE WHEN 4 * (p_partkey % 4) + 4 <= n THEN upper(hex(substr(p_name, 4 * (p_partkey % 4)::INT + 1, 4)::BLOB)) END AS fixed FROM (SELECT *, p_size % 12 - 1 AS o, p_partkey % 9 - 1 AS s, strlen(p_name) AS n FROM part)")
def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("p_name", "UTF-8")
    got = entries.read_chunk(data, F.col("p_size") % 12 - 1, F.col("p_partkey") % 9 - 1)
    fixed = entries.read_fixed(data, F.col("p_partkey") % 4, F.lit(4))
    rows = table(spark, sf_dir, "part").select("p_partkey", got.alias("g"), fixed.alias("f"))
    return rows.select("p_partkey", "g.error", F.hex("g.bytes").alias("chunk"), F.hex("f.bytes").alias("fixed"))


@query(
    f"""WITH {registry.WORKS_SQL}, w AS (SELECT DISTINCT work_id FROM n)
SELECT work_id, 'author' AS section, 0 AS ord, 'original' AS label, 'Default Author' AS name, NULL::BIGINT AS first, NULL::BIGINT AS stop FROM w
UNION ALL SELECT work_id, 'track', row_number() OVER (PARTITION BY work_id ORDER BY doc_id) - 1, 'Unknown', 'raw', NULL, k FROM n
UNION ALL SELECT work_id, 'signature', 0, 'Author Key (Default Author)', '{registry.SIGNERS.author.public_key().hex()}', NULL, NULL FROM w
UNION ALL SELECT work_id, 'signature', 1, 'TTP Key', '{registry.TTP_KEY}', NULL, NULL FROM w"""
)
def work_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report lists of each work: authors, tracks, and whose the signatures are."""
    return works.report_details(registry.signed_sources(spark, sf_dir)[0], registry.TTP_KEY)


# --- known answers ---

# Published vectors. BLAKE3 of bytes k mod 251, and RFC 8032's first tests of Ed25519.
_BLAKE3 = (
    (0, "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"), (1, "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"), (1024, "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"),
    (1025, "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"), (31744, "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47"),
)
_ED25519 = (
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "72", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
)


def _values(rows: tuple[tuple[object, ...], ...]) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


@query(f"SELECT * FROM (VALUES {_values(_BLAKE3)}) v(size, hash)")
def blake3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = spark.createDataFrame([(n,) for n, _ in _BLAKE3], "size int")
    data = F.unhex(F.array_join(F.transform(F.when(F.col("size") > 0, F.sequence(F.lit(0), F.col("size") - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.lpad(F.hex((k % 251).cast("bigint")), 2, "0")), ""))
    return sizes.select("size", hashing.hex_column(hashing.hash_column(data, "blake3")).alias("hash"))


@query(f"SELECT v.*, true AS valid, false AS tampered_valid FROM (VALUES {_values(_ED25519)}) v(seed, message, public_key, signature)")
def signature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and signatures are made by the signer; the column function verifies them, and no message with one more byte."""
    made = [(s, m, (k := ed25519.SigningKey(bytes.fromhex(s))).public_key().hex(), k.sign(bytes.fromhex(m)).hex()) for s, m, _, _ in _ED25519]
    rows = spark.createDataFrame(made, "seed string, message string, public_key string, signature string")
    check = lambda m: ed25519.verify_column(F.col("public_key"), F.unhex(m), F.col("signature"))
    return rows.withColumns({"valid": check(F.col("message")), "tampered_valid": check(F.concat("message", F.lit("00")))})


@query("SELECT n_nationkey, 20 + n_nationkey AS size, n_nationkey = 12 AS loads FROM nation")
def key_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private key files of many lengths, of which only 32 bytes load. Keys are the driver's, so this is a loop there over 25 rows."""
    out = []
    with tempfile.TemporaryDirectory() as folder:
        for (n,) in table(spark, sf_dir, "nation").select("n_nationkey").collect():
            path = Path(folder) / f"{n}.key"
            path.write_bytes(bytes(20 + n))
            try:
                loads = len(keys.load(str(path)).public_key()) == 32
            except ValueError:
                loads = False
            out.append((n, 20 + n, loads))
    return spark.createDataFrame(out, "n_nationkey bigint, size bigint, loads boolean")


_NULLS = ",".join(f'"{x}":null' for x in ("container_type", "codec_extradata", "width", "height", "sample_rate", "channel_count", "timebase_num", "timebase_den"))


@query(
    f"""SELECT c_custkey, '{{"type":"Original","work_id":"w' || c_custkey || '","title":"' || c_name || '","authors":[{{"author_id":"a","name":"' || c_name || '","role":"original"}}],"authorship_fingerprint":null,"created_at":"2024-01-01T00:00:00Z",'
  || '"tracks":[{{"track_id":' || c_custkey || ',"codec":"raw",{_NULLS},"merkle_root":"00","perceptual_hash":null,"total_chunks":2,"chunk_size":3,"chunk_index":[]}}]}}' AS content FROM customer"""
)
def canonical_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is hashed and signed: fields in their fixed order, absent ones null, unknown ones and blanks dropped."""
    loose = (
        '{"signatures": [], "content": {"junk": {"a": 1}, "tracks": [ {"codec": "raw", "track_id": %d, "merkle_root": "00", "zzz": 1, "total_chunks": 2, "chunk_size": 3} ], "title": "%s", "work_id": "w%d",'
        ' "type": "Original", "authors": [{"role": "original", "name": "%s", "author_id": "a"}], "created_at": "2024-01-01T00:00:00Z"}}'
    )
    key = F.col("c_custkey")
    text = F.format_string(loose, key, F.col("c_name"), key, F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.decode(canonical.content_column(text), "UTF-8").alias("content"))


# --- what fails ---


@query(
    """SELECT source AS work_id, kind, kind = 'whole' AS ok, CASE kind WHEN 'whole' THEN NULL WHEN 'byte' THEN 'merkle_root' ELSE 'malformed' END AS first_failure
FROM (SELECT DISTINCT source FROM documents WHERE strlen(text) > 0), (VALUES ('whole'), ('byte'), ('cut'), ('text')) v(kind)"""
)
def verified_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole container files, those with another last byte, those cut in their index, and files that are none, in one batch."""
    container.register(spark)
    path = fresh_path(spark, "containers")
    works.containers(*registry.signed_sources(spark, sf_dir), "concat(hex(work_id), '.smed')").write.format("provenance").mode("append").save(path)
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([0-9A-F]+)\.smed$", 1).alias("name"), "content")
    size = F.octet_length("content")
    last = F.when(F.hex(F.substring("content", -1, 1)) == "00", F.lit(b"\1")).otherwise(F.lit(b"\0"))
    kinds = {
        "whole": F.col("content"), "byte": F.concat(F.substr("content", F.lit(1), size - 1), last), "cut": F.substr("content", F.lit(1), F.lit(40)), "text": F.lit(b"not a container"),
    }
    each = files.select(F.explode(F.array(*[F.struct(F.concat("name", F.lit("/" + k)).alias("path"), c.alias("data")) for k, c in kinds.items()])).alias("f")).select("f.*")
    verdict = works.verify_containers(each, registry.TTP_KEY)
    name = F.split("work_id", "/")
    return verdict.select(F.decode(F.unhex(name[0]), "UTF-8").alias("work_id"), name[1].alias("kind"), "ok", "first_failure")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '{not json' WHEN 1 THEN '' WHEN 2 THEN '{}' END AS manifest, false AS ok, 'malformed' AS first_failure, false AS signed FROM customer")
def malformed_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fails by itself; none stops the batch."""
    text = F.get(F.array(F.lit("{not json"), F.lit(""), F.lit("{}"), F.lit(None).cast("string")), (F.col("c_custkey") % 4).cast("int"))
    manifests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("work_id"), text.alias("manifest"))
    none = spark.createDataFrame([], "work_id bigint, track_id bigint, chunk_index bigint, size bigint, data binary")
    verdict = works.verify(manifests, none, registry.TTP_KEY).select("work_id", "ok", "first_failure")
    return manifests.join(verdict, "work_id").join(verifier.has_signatures(manifests), "work_id").withColumnRenamed("work_id", "c_custkey")


_BAD = (
    ("unknown", "no such work"), ("track", "the work has no such track"), ("none", "neither times nor chunk indexes are given"), ("empty", "no usable range"), ("good", None),
)


@query(f"SELECT kind || '-' || w AS request_id, error FROM (SELECT DISTINCT user_id::VARCHAR AS w FROM events), (VALUES {_values(_BAD).replace('None', 'NULL')}) v(kind, error) WHERE error IS NOT NULL")
def clip_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request that gives no clip says why; good ones among them are no errors."""
    signed, chunks = registry.signed_audio(spark, sf_dir)
    kinds = spark.createDataFrame([(k,) for k, _ in _BAD], "kind string")
    asked = signed.select("work_id").join(F.broadcast(kinds), F.lit(True)).withColumn("request_id", F.concat_ws("-", "kind", "work_id"))  # broadcast: five rows
    kind, at = F.col("kind"), lambda good, empty: F.when(F.col("kind") == "none", None).when(F.col("kind") == "empty", empty).otherwise(good).cast("bigint")
    requests = asked.select(
        "request_id", F.col("request_id").alias("derivative_id"), F.when(kind == "unknown", F.concat(F.lit("x"), "work_id")).otherwise(F.col("work_id")).alias("work_id"),
        F.when(kind == "track", 7).otherwise(0).cast("bigint").alias("track_id"), F.lit(None).cast("double").alias("start_time"), F.lit(None).cast("double").alias("end_time"), at(0, 5).alias("start_chunk"), at(1, 5).alias("end_chunk"),
    )
    return works.clip(signed, chunks, written(requests, "requests"), registry.SIGNERS)[2].select("request_id", "error")


@query(
    """WITH c AS (SELECT user_id::VARCHAR AS w, (count(*) + 42) // 43 AS n FROM events GROUP BY user_id)
SELECT 'again-' || w AS request_id, CASE WHEN n > 1 THEN 'missing proof for chunk 1 in track 0' END AS error, CASE WHEN n > 1 THEN 0 ELSE 1 END AS n_chunks FROM c"""
)
def missing_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of clips whose manifests, signed as they are, lack the proof of chunk 1: an error, never a clip with a gap."""
    signed, chunks = registry.signed_audio(spark, sf_dir)
    request = lambda name, works_of, end: works_of.select(
        F.concat(F.lit(name), "w").alias("request_id"), F.concat(F.lit(name), "w").alias("derivative_id"), "work_id", F.lit(0).cast("bigint").alias("track_id"),
        F.lit(None).cast("double").alias("start_time"), F.lit(None).cast("double").alias("end_time"), F.lit(0).cast("bigint").alias("start_chunk"), F.lit(end).cast("bigint").alias("end_chunk"),
    )
    once = works.clip(signed, chunks, written(request("once-", signed.withColumn("w", F.col("work_id")), 2), "requests"), registry.SIGNERS)
    clips, parts = works.resigned(once[0], registry.SIGNERS, lambda content: _without_proof(content, 1)), once[1]
    clips, parts = written(clips, "clips"), written(parts, "clip-chunks")
    named = clips.withColumn("w", F.replace("work_id", F.lit("once-")))
    again = works.clip(clips, parts, written(request("again-", named, 2), "requests"), registry.SIGNERS)
    held = again[1].groupBy("work_id").agg(F.count("*").alias("n_chunks"))
    asked = named.select(F.concat(F.lit("again-"), "w").alias("request_id"))
    found = asked.join(again[2].select("request_id", "error"), "request_id", "left").join(held.withColumnRenamed("work_id", "request_id"), "request_id", "left")
    return found.select("request_id", "error", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def _without_proof(content: dict, index: int) -> dict:
    mappings = [{**m, "proofs": [p for p in m["proofs"] if p["chunk_index"] != index]} for m in content["clip_mappings"]]
    return {**content, "clip_mappings": mappings}


@query(
    """WITH c AS (SELECT user_id::VARCHAR AS w, (count(*) + 42) // 43 AS n FROM events GROUP BY user_id)
SELECT 'j' || w AS work_id, i AS chunk_index, i < least(2, n) AS valid FROM c, range(0, 4) t(i)"""
)
def json_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clip's manifest as JSON judges chunks by their indexes: its own, and chunks of indexes that it lacks."""
    signed, chunks = registry.signed_audio(spark, sf_dir)
    name = F.concat(F.lit("j"), "work_id")
    asked = signed.select(
        name.alias("request_id"), name.alias("derivative_id"), "work_id", F.lit(0).cast("bigint").alias("track_id"), F.lit(None).cast("double").alias("start_time"),
        F.lit(None).cast("double").alias("end_time"), F.lit(0).cast("bigint").alias("start_chunk"), F.lit(2).cast("bigint").alias("end_chunk"),
    )
    clips, parts, _ = works.clip(signed, chunks, written(asked, "requests"), registry.SIGNERS)
    numbers = written(clips, "clips").withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))))
    rows = numbers.join(parts.select("work_id", "chunk_index", "data"), ["work_id", "chunk_index"], "left").withColumn("data", F.coalesce("data", F.lit(b"other")))
    judged = verifier.verify_json(rows.select(F.struct("manifest", "work_id").alias("own"), "manifest", "chunk_index", "data"))
    return judged.select("own.work_id", "chunk_index", "valid")
