"""Commands on files: gen-key, sign, clip, extract, verify, verify-metadata, info. Each is one small Spark job; batches use plans.works directly."""

from __future__ import annotations

import argparse
import datetime
import json
import os
import sys
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediastrata.functions import keys
from mediastrata.operators.chunking import DEFAULT_CAP
from mediastrata.plans import works
from mediastrata.sources import container, external
from mediastrata.sources.media import idr_column, read_files

_REQUEST = "request_id int, derivative_id string, work_id string, track_id long, start_time double, end_time double, start_chunk long, end_chunk long"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mediastrata", description=__doc__)
    p.add_argument("--ttp-key", help="private key file of the trusted third party")
    p.add_argument("--ttp-public", help="its public key (hex), where only verifying")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[tuple[str, ...], dict]) -> None:
        c = commands.add_parser(name)
        for names, how in options:
            c.add_argument(*names, **how)

    into, key = (("--input",), {"required": True}), (("--key", "-k"), {"required": True})
    out = (("--output", "-o"), {"required": True})
    command("gen-key", (("--private", "-o"), {"default": "key.priv"}), (("--public", "-p"), {}))
    command("sign", (("--inputs", "-i"), {"required": True, "nargs": "+"}), key, out, (("--title", "-t"), {"default": "Untitled"}), (("--author-name",), {"default": "Default Author"}), (("--author-role",), {"default": "original"}), (("--chunk-size", "-c"), {"type": int, "default": DEFAULT_CAP}))
    command("clip", into, key, out, (("--clipper-name",), {}), (("--start",), {"type": int}), (("--end",), {"type": int}), (("--start-time",), {"type": float}), (("--end-time",), {"type": float}), (("--track",), {"type": int, "default": 0}))
    command("extract", into, out)
    command("verify", into)
    command("verify-metadata", (("--input",), {"help": "a media file, whose tags ffprobe reads"}), (("--tags",), {"help": "or a JSON file of its tags"}))
    command("info", into)
    return p


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat().replace("+00:00", "Z")


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The manifest and chunks of one container, as works takes them."""
    files = spark.read.format("binaryFile").load(path).select(F.lit("input").alias("path"), F.col("content").alias("data"))
    chunks = container.parse_files(files, "chunks")
    manifest = container.parse_files(files, "manifests").select(F.col("path").alias("work_id"), "manifest")
    codecs = container.parse_files(files, "tracks").select("track_id", "codec").distinct()
    rows = chunks.join(codecs, "track_id", "left").withColumn("is_idr", idr_column(F.col("data"), F.col("codec")))
    return manifest, rows.select(F.col("path").alias("work_id"), "track_id", "chunk_index", "pts", "is_idr", "offset", "size", "data")


def _save(manifests: DataFrame, chunks: DataFrame, path: str) -> None:
    rows = works.containers(manifests, chunks).toLocalIterator()  # one work, a part at a time
    if not container.write_rows(rows, lambda _: open(path, "wb")):
        raise SystemExit("No chunks selected")


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.command == "gen-key":
        print(keys.generate(a.private, a.public).public_key().hex())
        return 0
    spark = SparkSession.builder.appName("mediastrata").getOrCreate()
    for name, value in ((keys.TTP_PRIVATE_FILE, a.ttp_key), (keys.TTP_PUBLIC, a.ttp_public)):
        if value:
            spark.conf.set(name, value)
    if a.command == "verify-metadata":
        if a.tags:
            with open(a.tags) as f:
                tagged = spark.createDataFrame([({str(k): str(v) for k, v in json.load(f).items()},)], "tags map<string, string>")
        elif a.input:
            tagged = external.read_tags(read_files(spark, a.input))
        else:
            raise SystemExit("one of --input and --tags is needed")
        found = works.verify_metadata(tagged).first()["mismatches"]
        print(found or "Metadata verification OK")
        return int(bool(found))
    if a.command == "sign":
        files = [("work", k, bytearray(open(p, "rb").read())) for k, p in enumerate(a.inputs)]  # noqa: SIM115
        who = keys.signers(spark, keys.load(a.key), a.author_name)
        work = str(uuid.uuid4())
        rows = spark.createDataFrame([(work, k, d) for _, k, d in files], "work_id string, input_ord int, data binary")
        _save(*works.sign(rows, who, a.title, a.author_name, a.author_role, _now(), a.chunk_size), a.output)
        return 0
    manifests, chunks = _open(spark, a.input)
    if a.command == "verify":
        row = works.verify(manifests, chunks, keys.ttp_public(spark)).first()
        print(json.dumps({"ok": row["ok"], "failures": [f.asDict() for f in row["failures"]]}))
        return int(not row["ok"])
    if a.command == "info":
        for r in works.report(manifests).collect() + works.report_details(manifests, keys.ttp_public(spark)).orderBy("section", "ord").collect():
            print(json.dumps({k: v for k, v in r.asDict().items() if v is not None and k != "work_id"}))
        return 0
    if a.command == "clip":
        who = keys.signers(spark, keys.load(a.key), a.clipper_name)
        asked = [(0, str(uuid.uuid4()), "input", a.track, a.start_time, a.end_time, a.start, a.end)]
        clips, parts, errors = works.clip(manifests, chunks, spark.createDataFrame(asked, _REQUEST), who, _now())
        for r in errors.collect():  # one request
            raise SystemExit(r["error"])
        _save(clips, parts, a.output)
        return 0
    extension = os.path.splitext(a.output)[1].lstrip(".")
    rows = works.extract(manifests, chunks, extension).persist(StorageLevel.DISK_ONLY)
    for r in rows.where("error IS NOT NULL").orderBy("track_id").select("track_id", "error").collect():
        raise SystemExit(f"track {r['track_id']}: {r['error']}")
    for r in rows.orderBy("track_id", "part").toLocalIterator():  # a single raw track is the file; elementary streams stand beside one another, for a muxer
        path = a.output if r["mode"] == "passthrough" else f"{a.output}.{r['track_id']}.{r['codec']}"
        with open(path, "ab" if r["part"] else "wb") as f:
            f.write(bytes(r["data"]))
        if not r["part"]:
            print(path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
