"""Operators run on whole tables: every supplier, event, line, series, site and order."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rungwise import registry
from rungwise.operators import sequential as Q
from rungwise.plans import extras, files
from rungwise.sources import packages as K


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """66 suppliers and 150 events."""
    d = str(tmp_path_factory.mktemp("tables"))
    spark.range(1, 67).select(F.col("id").alias("s_suppkey"), (F.col("id") * 7.5).alias("s_acctbal")).write.parquet(f"{d}/supplier.parquet")
    spark.range(150).select(F.col("id").alias("event_id"), F.format_string('{"k": %d}', F.col("id") * 3).alias("props")).write.parquet(f"{d}/events.parquet")
    return d


IDS = {f"{i}" for i in range(1, 67)}


@pytest.mark.parametrize(
    ("name", "key"),
    [("seq2_error_diffusion", "frame"), ("seq2_conserved", "frame"), ("seq3_settle", "frame"), ("seq4_judged_settle", "frame"), ("seq6_convolution", "item"), ("agg34_soft_usage", "frame"), ("agg35_map_refinement", "frame"), ("agg39_baseline_judging", "frame")],
)
def test_every_supplier_is_a_frame(spark, small, name, key):
    rows = registry.queries()[name](spark, small).collect()
    assert {str(r[key]) for r in rows} == IDS


def test_every_supplier_is_a_container(spark, small):
    got = {r["path"]: r for r in registry.queries()["agg41_integrity"](spark, small).collect()}
    assert set(got) == {f"c{i}" for i in IDS} and [p for p, r in got.items() if not r["checksum_ok"]] == ["c4"]
    bins = registry.queries()["src16_container_bins"](spark, small).collect()
    assert {(r["path"], r["set_id"], r["bins"]) for r in bins} >= {(f"c{i}", s, 4096) for i in IDS - {"4"} for s in range(2)}
    assert {r["path"] for r in registry.queries()["src16_slow_block"](spark, small).collect()} == {f"c{i}" for i in IDS if int(i) % 2}


def test_container_bins_never_leave_their_task(spark, small):
    """Totals are those of the rows a bin; the plan makes none of them, and deals a small table of suppliers to several tasks."""
    wide, made = K.containers(files.container_files(spark, small)), files.container_files(spark, small)
    want = wide.groupBy("path", "set_id").agg(F.count(F.lit(1)).alias("bins"), F.sum("l_code").alias("l_code"), F.sum("flags").alias("flags"))
    assert sorted(K.container_totals(made, ["l_code", "flags"]).collect()) == sorted(want.collect())
    assert "chi2" not in plan_of(registry.queries()["src16_container_bins"](spark, small))


def test_slow_bins_never_leave_their_task(spark, small, monkeypatch):
    monkeypatch.setattr(files, "CONTAINERS", 20)
    made = files.container_files(spark, small)
    want = K.slow_blocks(made).groupBy("path").agg(F.count(F.lit(1)).alias("bins"), F.sum("motion").alias("motion"), F.sum("l_var").alias("l_var"))
    assert sorted(K.slow_totals(made, ["motion", "l_var"]).collect()) == sorted(want.collect())
    assert made.rdd.getNumPartitions() == 4
    assert "cov_la" not in plan_of(registry.queries()["src16_slow_block"](spark, small))


def test_every_event_is_scanned(spark, small):
    got = registry.queries()["src17_golden_scan"](spark, small).collect()
    assert sorted((r["id"], r["k"]) for r in got) == [(i, 3 * i) for i in range(150)]


def test_settled_frames_follow_the_plain_loop(spark, small):
    """Three frames settled one candidate after the other."""
    from test_laws import plain_settle

    got = {}
    for r in registry.queries()["seq3_settle"](spark, small).filter("frame <= 3").collect():
        got.setdefault(r["frame"], {})[r["site"]] = r["idx"]
    near = files.settle_candidates(spark, small).filter("frame <= 3").toPandas().sort_values(["pos", "rank"])
    for frame, part in near.groupby("frame"):
        home = part[part["rank"] == 0]
        base = dict(zip(home["pos"], home["d2"] ** 0.5))
        moves = sorted((d**0.5 - base[p], p, k, q) for p, k, q, d in zip(part["pos"], part["rank"], part["idx"], part["d2"]) if k and d**0.5 - base[p] <= 2000.0)
        place = {p: i for i, p in enumerate(home["pos"])}
        want = plain_settle(home["idx"].tolist(), [(c, place[p], q) for c, p, _, q in moves], 256, 400.0)[0]
        assert [got[frame][i] for i in range(256)] == want


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_conserved_reads_no_site_twice(spark, small):
    plan = plan_of(registry.queries()["seq2_conserved"](spark, small))
    assert plan.count("Relation [s_") <= 1 and plan.count("parquet") <= 1


@pytest.mark.parametrize("name", ["seq3_settle", "seq4_judged_settle", "agg39_baseline_judging"])
def test_candidates_never_leave_their_task(spark, small, name):
    """Eight rows a site, chosen of 256 built by the plan, took most of the time."""
    assert "sort_array" not in plan_of(registry.queries()[name](spark, small))


def test_frames_in_batches_are_frames_one_by_one(spark, small, monkeypatch):
    monkeypatch.setattr(Q, "SITES", 700)
    sites, bell = files.walk_sites(spark, small).filter("frame <= 7"), files.q16_bell(spark)
    want = {r["frame"]: r for r in Q.settled(files.settle_candidates(spark, small).filter("frame <= 7"), 2000.0).collect()}
    assert {r["frame"]: r for r in Q.settled_sites(sites, bell, 8, 2000.0).collect()} == want and len(want) == 7
    tables = [pa.RecordBatch.from_pydict({"frame": f}) for f in ([1, 1, 1], [1], [1, 2], [2, 2, 2], [3], [4])]
    assert [t.column("frame").to_pylist() for t in Q.whole_frames(tables, 2)] == [[1] * 5, [2] * 4 + [3], [4]]
    target, entries = sites.orderBy("frame", "y", "x").toPandas()[["l", "a", "b"]].to_numpy(), Q.entries_of(bell)
    idx, dropped = Q.diffuse_frames(entries, target.reshape(7, 256, 3), 16, 2)
    for f in range(7):
        one = Q.diffuse(entries, target.reshape(7, 256, 3)[f], 16, 2)
        assert (one[0] == idx[f]).all() and (one[1] == dropped[f]).all()
    assert (target.reshape(7, 256, 3) - entries[idx]).sum(1).tolist() == dropped.tolist()


def test_bundle_holds_every_cycle(spark, small, monkeypatch):
    paths, made = [], extras.shared_path
    monkeypatch.setattr(extras, "shared_path", lambda *a: paths.append(made(*a)) or paths[-1])
    assert registry.queries()["snk6_burst_bundle"](spark, small).collect()[0]["intact"]
    assert spark.read.parquet(f"{paths[0]}/frames").select("cycle").distinct().count() == files.seeds(spark, small).count()


# ---------------------------------------------------------------- lines, series, lattice rows, brackets


@pytest.mark.parametrize("name", ["prj4_apply_matrix", "prj13_transfer_lookup", "prj5_9_camera_matrix", "prj8_forward_matrix"])
def test_every_item_line_takes_the_colour_path(spark, sf, name):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    ids = registry.queries()[name](spark, sf).select("id")
    assert ids.exceptAll(lines).count() == 0 and lines.exceptAll(ids).count() == 0


def test_all_colour_queries_take_all_lines_that_are_not_black(spark, sf):
    q = registry.queries()
    n = q["prj4_apply_matrix"](spark, sf).filter("cx > 0").count()
    assert n >= q["prj3_pinned_cube_root"](spark, sf).count() > 0.99 * n
    assert len({q[k](spark, sf).count() for k in ("prj3_pinned_cube_root", "prj10_oklab", "prj14_palette_bytes", "prj15_delta")}) == 1


def test_every_series_has_its_changes(spark, sf):
    stream = spark.read.parquet(f"{sf}/events.parquet").select("event_id")
    changed = {r["pos"] for r in registry.queries()["flt4_changed"](spark, sf).collect()}
    assert changed == {r["event_id"] for r in stream.collect() if r["event_id"] % 5 == 0}
    assert registry.queries()["jn10_apply_delta"](spark, sf).select("pos").exceptAll(stream.select(F.col("event_id").alias("pos"))).count() == 0
    assert registry.queries()["jn10_apply_delta"](spark, sf).count() == stream.count()


def test_every_site_has_its_neighbours_counted(spark, sf):
    got = {(r["y"], r["x"]): r["inside"] for r in registry.queries()["flt5_in_frame"](spark, sf).collect()}
    assert got == {(y, x): (x < 63) + (y < 63 and x > 0) + (y < 63) + (y < 63 and x < 63) for y in range(64) for x in range(64)}


def test_every_order_is_in_a_bracket(spark, sf):
    q = registry.queries()
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey").toPandas().sort_values(["o_custkey", "o_orderkey"])
    nth = orders.groupby("o_custkey").cumcount()
    want = sorted(zip(orders["o_custkey"] * (1 << 20) + nth // 4, nth % 4, 100.0 * (1 + orders["o_orderkey"] % 13)))
    assert sorted((r["cycle"], r["frame"], r["iso"]) for r in q["agg1_relative_exposure"](spark, sf).collect()) == want
    for name in ("win7_ratio_to_extremes", "prj39_stops", "prj31_bounded_plan", "jn14_last_known_plan", "win8_last_good"):
        assert q[f"{name}"](spark, sf).count() == len(want)
    cycles = {c for c, _, _ in want}
    for name in ("flt6_metadata_validity", "flt7_profile_gate", "prj38_base_frame", "jn13_governing_palette"):
        assert {r["cycle"] for r in q[f"{name}"](spark, sf).collect()} == cycles
    assert {r["burst"] for r in q["str5_failure_budget"](spark, sf).collect()} == {c // 16 for c in cycles}
