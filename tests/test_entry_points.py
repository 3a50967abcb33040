"""The command-line entry points over files of their own."""

import json

import numpy as np
import pytest

from rungwise import __main__ as M
from rungwise.sources import bundles
from rungwise.sources import packages as K
from rungwise.sources import rawfile as R


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    y, x = np.mgrid[0:32, 0:32]
    for k in range(8):
        s = np.minimum(4095, 560 + (y * 31 + x * 17) % 700 * (k % 4 + 1))
        (d / f"f{k}.dng").write_bytes(R.build(s.astype(np.uint16), compression=7 if k % 2 else 1))
    (d / "g.dng").write_bytes(b"none")
    return str(d)


def test_raw_files(spark, raw):
    colours = M.render(spark, raw, 4)
    assert colours.count() == 8 * 64 and colours.filter("l <= 0 OR l > 90000").count() == 0
    assert {r["path"].rsplit("/")[-1] for r in M.noise(spark, raw).collect()} == {f"f{k}.dng" for k in range(8)}
    fused = M.abfuse(spark, raw).collect()
    assert len(fused) == 2 and all(r["places"] == 1024 and 0 <= r["mean_apart"] <= r["most_apart"] for r in fused)


def test_containers_streams_and_lines(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.bin").write_bytes(K.build_container(2, 4))
    got = M.cube(spark, str(tmp_path / "c")).collect()
    assert [(r["sets"], r["bins"], r["checksum_ok"]) for r in got] == [(2, 4096, True)] * 2
    spark.createDataFrame([(0, i, i, i % 256) for i in range(512)], "series long, pos long, moment long, idx long").write.parquet(str(tmp_path / "s"))
    assert [(r["n"], r["chi2"], r["churn"]) for r in M.battle(spark, str(tmp_path / "s")).collect()] == [(512, 0.0, 511)]
    (tmp_path / "m.jsonl").write_text(json.dumps({"event": "eval", "step": 3, "chi2": 1.5}) + "\n{broken\n")
    assert M.watch(spark, str(tmp_path / "m.jsonl")).count() == 1


def test_bundles_and_queries(spark, sf, tmp_path):
    path = f"{tmp_path}/bundle"
    bundles.write({"frames": spark.range(10).selectExpr("id", "id % 2 AS burst")}, path, ["burst"])
    assert M.verify(spark, path, ["frames"]).first()["intact"]
    M.main(["query", sf, "--name", "agg9_balance", "--out", f"{tmp_path}/out"])
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0
