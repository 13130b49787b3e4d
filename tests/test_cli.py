"""The commands, from keys to a clip that verifies."""

from __future__ import annotations

import json

import pytest

from mediastrata import cli
from mediastrata.functions import keys
from mediastrata.plans import works
from tests import media_samples as make


def test_commands(spark, tmp_path, capsys):
    at = lambda n: str(tmp_path / n)
    cli.main(["gen-key", "-o", at("a.priv"), "-p", at("a.pub")])
    cli.main(["gen-key", "-o", at("t.priv"), "-p", at("t.pub")])
    (tmp_path / "in.aac").write_bytes(make.adts(200))
    ttp = ["--ttp-key", at("t.priv")]
    assert cli.main([*ttp, "sign", "-i", at("in.aac"), "-k", at("a.priv"), "-o", at("w"), "--author-name", "Ann"]) == 0
    assert cli.main([*ttp, "verify", "--input", at("w")]) == 0
    assert cli.main([*ttp, "clip", "--input", at("w"), "-k", at("a.priv"), "-o", at("c"), "--start-time", "1", "--end-time", "2"]) == 0
    assert cli.main([*ttp, "verify", "--input", at("c")]) == 0
    damaged = bytearray((tmp_path / "c").read_bytes())
    damaged[-1] ^= 1
    (tmp_path / "d").write_bytes(damaged)
    capsys.readouterr()
    assert cli.main([*ttp, "verify", "--input", at("d")]) == 1
    assert json.loads(capsys.readouterr().out)["failures"][0]["code"] == "chunk_hash"
    assert cli.main([*ttp, "extract", "--input", at("w"), "-o", at("out.mp4")]) == 0
    assert (tmp_path / "out.mp4.0.aac").read_bytes() == make.adts(200)
    manifests, _ = cli._open(spark, at("w"))
    tags = dict(works.tags(manifests, keys.ttp_public(spark)).first()["tags"])
    (tmp_path / "tags.json").write_text(json.dumps(tags))
    assert cli.main(["verify-metadata", "--tags", at("tags.json")]) == 0
    (tmp_path / "tags.json").write_text(json.dumps({**tags, "smed.content_hash": "00"}))
    assert cli.main(["verify-metadata", "--tags", at("tags.json")]) == 1
    spark.conf.set(keys.TTP_PUBLIC, (tmp_path / "a.pub").read_text())
    with pytest.raises(ValueError, match="aren't a pair"):
        keys.signers(spark, keys.load(at("a.priv")))
    spark.conf.unset(keys.TTP_PUBLIC)
    spark.conf.unset(keys.TTP_PRIVATE_FILE)
    (tmp_path / "short").write_bytes(b"x")
    with pytest.raises(ValueError, match="Invalid key size"):
        keys.load(at("short"))
