"""Queries over the colour path and palettes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungwise.functions import colour as C
from rungwise.functions import lattice as L
from rungwise.operators import palette as P
from rungwise.registry import query
from rungwise.sources import views as V


def lit(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def linear(spark, d):
    """id, r, g, b: linear triples in [0, 1] from item lines."""
    k = F.col("l_orderkey")
    part = lambda m, s: ((k * m + F.col("l_partkey") * s) % 4096).cast("double") / F.lit(4096.0)
    return V.table(spark, d, "lineitem").select((k * 8 + F.col("l_linenumber")).alias("id"), part(37, 11).alias("r"), part(53, 7).alias("g"), part(101, 3).alias("b"))


LINEAR = "linear AS (SELECT l_orderkey * 8 + l_linenumber AS id, " + ", ".join(f"CAST((l_orderkey * {m} + l_partkey * {s}) % 4096 AS DOUBLE) / {lit(4096.0)} AS {c}" for m, s, c in ((37, 11, "r"), (53, 7, "g"), (101, 3, "b"))) + " FROM lineitem)"


def dot_sql(row, names) -> str:
    return " + ".join(f"{lit(m)} * {n}" for m, n in zip(row, names))


def root_sql(source: str, names: list[str], keep: str) -> str:
    """Pinned cube roots of positive columns, one subquery a step."""
    s = f"SELECT {keep}, " + ", ".join(f"{n}, floor(log2(abs({n}))) AS e_{n}" for n in names) + f" FROM {source}"
    s = "SELECT *, " + ", ".join(f"abs({n}) / pow({lit(2.0)}, e_{n}) AS g_{n}" for n in names) + f" FROM ({s})"
    s = f"SELECT {keep}, " + ", ".join(
        f"sign({n}) AS s_{n}, CASE WHEN g_{n} >= 2 THEN g_{n} / 2 WHEN g_{n} < 1 THEN g_{n} * 2 ELSE g_{n} END AS f_{n}, e_{n} + CASE WHEN g_{n} >= 2 THEN 1 WHEN g_{n} < 1 THEN -1 ELSE 0 END AS e_{n}" for n in names
    ) + f" FROM ({s})"
    s = "SELECT *, " + ", ".join(f"{lit(0.75)} + f_{n} / 4 AS y0_{n}" for n in names) + f" FROM ({s})"
    for i in range(4):
        s = "SELECT *, " + ", ".join(f"({lit(2.0)} * y{i}_{n} + f_{n} / (y{i}_{n} * y{i}_{n})) / 3 AS y{i + 1}_{n}" for n in names) + f" FROM ({s})"
    pick = lambda n: f"CASE ((CAST(e_{n} AS BIGINT) % 3) + 3) % 3 WHEN 0 THEN {lit(1.0)} WHEN 1 THEN {lit(C.CBRT_2)} ELSE {lit(C.CBRT_4)} END"
    return f"SELECT {keep}, " + ", ".join(f"s_{n} * (y4_{n} * {pick(n)}) * pow({lit(2.0)}, floor(e_{n} / 3)) AS {n}" for n in names) + f" FROM ({s})"


NZ = "linear_nz AS (SELECT * FROM linear WHERE r > 0 AND g > 0 AND b > 0)"


@query("prj3_pinned_cube_root", f"WITH {LINEAR}, {NZ} " + root_sql("linear_nz", ["r", "g", "b"], "id"))
def pinned_cube_root(spark, d):
    return C.with_cube_roots(linear(spark, d).filter("r > 0 AND g > 0 AND b > 0"), ["r", "g", "b"])


@query("prj4_apply_matrix", f"WITH {LINEAR} SELECT id, " + ", ".join(f"{dot_sql(row, 'rgb')} AS {n}" for row, n in zip(C.PROPHOTO_TO_XYZ_D50, ("cx", "cy", "cz"))) + " FROM linear")
def apply_matrix(spark, d):
    out = C.apply3(C.PROPHOTO_TO_XYZ_D50, [F.col(c) for c in "rgb"])
    return linear(spark, d).select("id", *[c.alias(n) for c, n in zip(out, ("cx", "cy", "cz"))])


def _lms_sql(m) -> str:
    return "SELECT id, " + ", ".join(f"{dot_sql(row, 'rgb')} AS m{i}" for i, row in enumerate(m)) + " FROM linear_nz"


def oklab_sql(m) -> str:
    return "SELECT id, " + ", ".join(f"{dot_sql(row, ('m0', 'm1', 'm2'))} AS {n}" for row, n in zip(C.LMS_TO_LAB, ("lab_l", "lab_a", "lab_b"))) + " FROM (" + root_sql(f"({_lms_sql(m)})", ["m0", "m1", "m2"], "id") + ")"


OKLAB = f"{LINEAR}, {NZ}, oklab AS ({oklab_sql(C.prophoto_to_lms())})"


def oklab(spark, d):
    rows = linear(spark, d).filter("r > 0 AND g > 0 AND b > 0")
    return C.to_oklab(rows, ["r", "g", "b"], ["lab_l", "lab_a", "lab_b"]).select("id", "lab_l", "lab_a", "lab_b")


@query("prj10_oklab", f"WITH {OKLAB} SELECT * FROM oklab")
def to_oklab(spark, d):
    return oklab(spark, d)


Q16 = f"{OKLAB}, q16 AS (SELECT id, " + ", ".join(f"CAST(floor(lab_{c} * 65536.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS {c}" for c in "lab") + " FROM oklab)"


def q16(spark, d):
    return oklab(spark, d).select("id", *[C.quantised(F.col(f"lab_{c}")).alias(c) for c in "lab"])


@query("prj11_quantise", f"WITH {Q16} SELECT *, CAST(l AS DOUBLE) / 65536 AS back FROM q16")
def quantise(spark, d):
    return q16(spark, d).withColumn("back", C.dequantised(F.col("l")))


def _display_sql() -> str:
    deq = "SELECT id, l, a, b, " + ", ".join(f"CAST({c} AS DOUBLE) / {lit(65536.0)} AS d{c}" for c in "lab") + " FROM q16"
    roots = "SELECT id, l, a, b, " + ", ".join(f"dl + {lit(r[1])} * da + {lit(r[2])} * db AS r{i}" for i, r in enumerate(C.LAB_TO_LMS_ROOT)) + f" FROM ({deq})"
    cubes = "SELECT id, l, a, b, " + ", ".join(f"r{i} * r{i} * r{i} AS c{i}" for i in range(3)) + f" FROM ({roots})"
    return "SELECT id, l, a, b, " + ", ".join(f"{dot_sql(row, ('c0', 'c1', 'c2'))} AS {n}" for row, n in zip(C.LMS_TO_SRGB, ("lr", "lg", "lb"))) + f" FROM ({cubes})"


DISPLAY = f"{Q16}, display AS ({_display_sql()})"


@query("prj12_linear_display", f"WITH {DISPLAY} SELECT id, lr, lg, lb FROM display")
def linear_display(spark, d):
    rows = q16(spark, d).select("id", *[C.dequantised(F.col(c)).alias(f"d{c}") for c in "lab"])
    return C.to_linear_display(rows, ["dl", "da", "db"], ["lr", "lg", "lb"]).select("id", "lr", "lg", "lb")


def _byte_sql(c: str) -> str:
    i = f"least(greatest(CAST(floor({c} * {lit(4095.0)} + {lit(0.5)}) AS BIGINT), 0), 4095)"
    v = f"CAST({i} AS DOUBLE) / 4095"
    s = f"CASE WHEN {v} <= 0.0031308::DOUBLE THEN {lit(12.92)} * ({v}) ELSE {lit(1.055)} * pow({v}, {lit(1 / 2.4)}) - {lit(0.055)} END"
    return f"CAST(greatest(0, least(255, floor(255 * ({s}) + {lit(0.5)}))) AS BIGINT)"


@query("prj13_transfer_lookup", f"WITH {LINEAR} SELECT id, {_byte_sql('r')} AS r8, {_byte_sql('g')} AS g8, {_byte_sql('b')} AS b8 FROM linear")
def transfer_lookup(spark, d):
    return linear(spark, d).select("id", *[C.display_byte(F.col(c)).alias(f"{c}8") for c in "rgb"])


@query("prj14_palette_bytes", f"WITH {DISPLAY} SELECT id, l, a, b, {_byte_sql('lr')} AS r8, {_byte_sql('lg')} AS g8, {_byte_sql('lb')} AS b8 FROM display")
def palette_bytes(spark, d):
    return C.palette_bytes(q16(spark, d))


@query("prj15_delta", f"WITH {Q16} SELECT id, l * l + a * a + b * b AS d2, a * a + b * b AS chroma2, sqrt(CAST(l * l + a * a + b * b AS DOUBLE)) AS d FROM q16")
def delta(spark, d):
    zero = [F.lit(0).cast("long")] * 3
    cols = [F.col(c) for c in "lab"]
    return q16(spark, d).select("id", C.delta_squared(cols, zero).alias("d2"), C.delta_squared(cols[1:], zero[1:]).alias("chroma2"), C.delta(cols, zero).alias("d"))


MATS = "mats AS (SELECT o_orderkey AS id, " + ", ".join(f"CAST((o_orderkey * {7 + 4 * i} + o_custkey * {3 + i}) % 17 - 8 AS DOUBLE) AS m{i}" for i in range(9)) + " FROM orders)"


@query(
    "prj6_inverse",
    f"""WITH {MATS}, det AS (SELECT *, m0 * (m4 * m8 - m5 * m7) - m1 * (m3 * m8 - m5 * m6) + m2 * (m3 * m7 - m4 * m6) AS det FROM mats),
o AS (SELECT *, CASE WHEN abs(det) > 1e-12 THEN {lit(1.0)} / det END AS o FROM det)
SELECT id, (m4 * m8 - m5 * m7) * o AS i0, (m2 * m7 - m1 * m8) * o AS i1, (m1 * m5 - m2 * m4) * o AS i2, (m5 * m6 - m3 * m8) * o AS i3, (m0 * m8 - m2 * m6) * o AS i4,
(m2 * m3 - m0 * m5) * o AS i5, (m3 * m7 - m4 * m6) * o AS i6, (m1 * m6 - m0 * m7) * o AS i7, (m0 * m4 - m1 * m3) * o AS i8 FROM o""",
)
def inverse(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    m = V.table(spark, d, "orders").select(k.alias("id"), *[((k * (7 + 4 * i) + c * (3 + i)) % 17 - 8).cast("double").alias(f"m{i}") for i in range(9)])
    out = C.scaled_inverse(m, [f"m{i}" for i in range(9)], [f"i{i}" for i in range(9)])
    return out.select("id", *[F.when(F.col(f"i{i}").isNotNull(), F.col(f"i{i}")).alias(f"i{i}") for i in range(9)])


#: A device's colour tags as rationals (fixed values).
COLOUR_TAG = [[23439 / 24499, -46959 / 123674, -15473 / 119683], [-66223 / 156922, 161308 / 123231, 5846 / 65367], [-8383 / 84491, 6997 / 33292, 20525 / 43929]]
NEUTRAL = [29791 / 70950, 1 / 1, 73143 / 144911]


@query("prj5_9_camera_matrix", f"WITH {LINEAR} SELECT id, " + ", ".join(f"{dot_sql(row, 'rgb')} AS {n}" for row, n in zip(C.camera_by_colour(COLOUR_TAG, NEUTRAL), ("pr", "pg", "pb"))) + " FROM linear")
def camera_matrix(spark, d):
    m = C.camera_matrix(NEUTRAL, colour2=COLOUR_TAG)
    return linear(spark, d).select("id", *[c.alias(n) for c, n in zip(C.apply3(m, [F.col(c) for c in "rgb"]), ("pr", "pg", "pb"))])


#: A made-up forward matrix whose rows map white to the connection space's white.
FORWARD_TAG = [[0.62, 0.21, 0.1342], [0.27, 0.71, 0.02], [0.03, 0.06, 0.7351]]


@query("prj8_forward_matrix", f"WITH {LINEAR} SELECT id, " + ", ".join(f"{dot_sql(row, 'rgb')} AS {n}" for row, n in zip(C.mul3(C.XYZ_TO_PROPHOTO_D50, [[m * (NEUTRAL[1] / NEUTRAL[0]), m1 * 1.0, m2 * (NEUTRAL[1] / NEUTRAL[2])] for m, m1, m2 in FORWARD_TAG]), ("pr", "pg", "pb"))) + " FROM linear")
def forward_matrix(spark, d):
    """The camera path of files with a forward matrix, which goes before a colour matrix."""
    m = C.camera_matrix(NEUTRAL, forward2=FORWARD_TAG, colour2=COLOUR_TAG)
    return linear(spark, d).select("id", *[c.alias(n) for c, n in zip(C.apply3(m, [F.col(c) for c in "rgb"]), ("pr", "pg", "pb"))])


@query("prj35_neutral_law", "SELECT true AS lawful")
def neutral_law(spark, d):
    spread = C.neutral_spread(C.camera_matrix(NEUTRAL, colour2=COLOUR_TAG), NEUTRAL)
    return spark.range(1).select((F.lit(spread) < 1e-5).alias("lawful"))


@query("prj43_white_point", "SELECT " + ", ".join(f"{lit(w)} AS {n}" for w, n in zip(C.white_d50(), "xyz")))
def white_point(spark, d):
    ones = spark.range(1).select(*[F.lit(1.0).alias(c) for c in "rgb"])
    return ones.select(*[c.alias(n) for c, n in zip(C.apply3(C.PROPHOTO_TO_XYZ_D50, [F.col(c) for c in "rgb"]), "xyz")])


@query("prj26_seed_palette", "SELECT i AS idx, round(0.15 + 0.7 * (i // 16) / 15, 9) AS l, round(0.1 * cos(2 * pi() * (i % 16) / 16), 9) + 0.0 AS a, round(0.1 * sin(2 * pi() * (i % 16) / 16), 9) + 0.0 AS b FROM range(256) r(i)")
def seed_palette(spark, d):
    return P.seed_palette(spark).select("idx", *[(F.round(F.col(c), 9) + F.lit(0.0)).alias(c.lower()) for c in ("L", "A", "B")])


BELL = """strata AS (SELECT k, c, CAST(sum(c) OVER (ORDER BY k) - c AS BIGINT) AS start FROM (SELECT unnest(range(16)) AS k, unnest([1, 1, 2, 4, 8, 16, 32, 64, 64, 32, 16, 8, 4, 2, 1, 1]) AS c)),
bell AS (SELECT start + p AS idx, k AS stratum, p AS place, CAST(c AS BIGINT) AS count FROM strata, LATERAL (SELECT unnest(range(c)) AS p))"""


@query("prj45_bell_strata", f"WITH {BELL} SELECT * FROM bell")
def bell_strata(spark, d):
    return P.strata(spark)


@query(
    "prj26_bell_palette",
    f"""WITH {BELL} SELECT idx, round(CASE WHEN idx = 0 THEN 0.0 WHEN idx = 255 THEN 1.0 ELSE (stratum + (place + 0.5) / count) / 16 END, 9) AS l,
round(CASE WHEN idx IN (0, 255) OR count < 4 THEN 0.0 ELSE 0.1 * cos(2 * pi() * place / count) END, 9) + 0.0 AS a,
round(CASE WHEN idx IN (0, 255) OR count < 4 THEN 0.0 ELSE 0.1 * sin(2 * pi() * place / count) END, 9) + 0.0 AS b FROM bell""",
)
def bell_palette(spark, d):
    return P.bell_palette(spark).select("idx", *[(F.round(F.col(c), 9) + F.lit(0.0)).alias(c.lower()) for c in ("L", "A", "B")])


PR = V.PROBES_SQL
D2 = "(p.l - t.l) * (p.l - t.l) + (p.a - t.a) * (p.a - t.a) + (p.b - t.b) * (p.b - t.b)"


@query("jn2_nearest_entry", f"WITH {PR} SELECT t.pos, t.l, t.a, t.b, arg_min(p.idx, ROW({D2}, p.idx)) AS idx, min({D2}) AS d2 FROM targets t, palette p GROUP BY ALL")
def nearest_entry(spark, d):
    palette, targets = V.probes(spark, d)
    return P.nearest(targets, palette)


@query("jn16_alternatives", f"WITH {PR}, r AS (SELECT t.pos, p.idx, {D2} AS d2, row_number() OVER (PARTITION BY t.pos ORDER BY {D2}, p.idx) - 1 AS rank FROM targets t, palette p) SELECT * FROM r WHERE rank < 8")
def alternatives(spark, d):
    palette, targets = V.probes(spark, d)
    return P.alternatives(targets, palette, 8)


SITES = f"{V.lattice_sql(64)}, sites AS (SELECT y, x, v * 16 AS l, (v * 7) % 4096 - 2048 AS a, (v * 13) % 4096 - 2048 AS b FROM lattice)"


def sites(spark, d):
    v = F.col("v")
    return V.lattice(spark, d).select("y", "x", (v * 16).alias("l"), ((v * 7) % 4096 - 2048).alias("a"), ((v * 13) % 4096 - 2048).alias("b"))


@query(
    "jn3_window_choice",
    f"""WITH {PR}, {SITES} SELECT t.y, t.x, arg_min(p.idx, ROW({D2}, p.idx)) AS idx, min({D2}) AS d2 FROM sites t JOIN palette p
ON abs(p.idx // 16 - t.y * 16 // 64) <= 2 AND abs(p.idx % 16 - t.x * 16 // 64) <= 2 GROUP BY t.y, t.x""",
)
def window_choice(spark, d):
    palette, _ = V.probes(spark, d)
    return P.window_choice(sites(spark, d), palette, 64, 2)


@query("jn12_index_colour", f"WITH {V.INDEX_SQL}, {PR} SELECT pos, idx, l, a, b FROM index_stream JOIN palette USING (idx)")
def index_colour(spark, d):
    palette, _ = V.probes(spark, d)
    return P.coloured(V.index_stream(spark, d).select("pos", "idx"), palette).select("pos", "idx", "l", "a", "b")


@query("win5_rank_targets", f"WITH {PR}, {BELL}, ranked AS (SELECT *, row_number() OVER (ORDER BY l, idx) - 1 AS rank FROM palette) SELECT ranked.idx, rank, l, stratum FROM ranked JOIN bell ON bell.idx = rank")
def rank_targets(spark, d):
    palette, _ = V.probes(spark, d)
    one = palette.withColumn("g", F.lit(0))
    return P.by_rank(one, P.strata(spark).select(F.col("idx").alias("rank"), "stratum"), ["g"]).select("idx", "rank", "l", "stratum")


@query(
    "jn15_monotone_remap",
    f"""WITH {PR}, k AS (SELECT DISTINCT l AS k, 2.0::DOUBLE * l + 1 AS "to" FROM palette WHERE idx % 16 = 0), t AS (SELECT DISTINCT pos, l FROM targets),
b AS (SELECT t.*, max(k.k) FILTER (k.k <= t.l) AS lo, min(k.k) FILTER (k.k > t.l) AS hi FROM t, k GROUP BY t.pos, t.l)
SELECT pos, l, round(CASE WHEN lo IS NULL THEN 2.0::DOUBLE * hi + 1 WHEN hi IS NULL THEN 2.0::DOUBLE * lo + 1 ELSE (2.0::DOUBLE * lo + 1) + CAST(l - lo AS DOUBLE) / (hi - lo) * ((2.0::DOUBLE * hi + 1) - (2.0::DOUBLE * lo + 1)) END, 6) AS mapped FROM b""",
)
def monotone_remap(spark, d):
    palette, targets = V.probes(spark, d)
    knots = palette.filter("idx % 16 = 0").select(F.col("l").alias("k"), (F.lit(2.0) * F.col("l") + 1).alias("to")).distinct()
    return P.remapped(targets.select("pos", "l"), knots).withColumn("mapped", F.round("mapped", 6))


@query("prj22_patch_key", f"WITH {V.lattice_sql(64)} SELECT y, x, (y // 16 * 16 + x // 16) * 256 + (y % 16) * 16 + x % 16 AS key, y AS y2, x AS x2 FROM lattice")
def patch_key(spark, d):
    rows = V.lattice(spark, d).select("y", "x", L.patch_key(F.col("y"), F.col("x")).alias("key"))
    y, x = L.patch_place(F.col("key"))
    return rows.select("y", "x", "key", y.alias("y2"), x.alias("x2"))


@query("prj23_serpentine_key", f"WITH {V.lattice_sql(64)} SELECT y, x, y * 64 + CASE WHEN y % 2 = 0 THEN x ELSE 63 - x END AS key FROM lattice")
def serpentine_key(spark, d):
    return V.lattice(spark, d).select("y", "x", L.serpentine_key(F.col("y"), F.col("x"), 64).alias("key"))


@query("srt4_row_major", f"WITH {V.lattice_sql(64)} SELECT v, CAST(row_number() OVER (ORDER BY y, x) - 1 AS BIGINT) AS place FROM lattice")
def row_major(spark, d):
    """Values emitted along the serpentine, put back in row order by the inverse key."""
    key = L.serpentine_key(F.col("y"), F.col("x"), 64)
    emitted = V.lattice(spark, d).select(key.alias("at"), "v")
    y, x = F.floor(F.col("at") / 64), F.col("at") % 64
    return emitted.select("v", (y * 64 + F.when(y % 2 == 0, x).otherwise(63 - x)).alias("place"))


@query("prj24_home_cell", f"WITH {V.lattice_sql(64)} SELECT y, x, y * 16 // 64 AS hv, x * 16 // 64 AS hu FROM lattice")
def home_cell(spark, d):
    v, u = L.home(F.col("y"), F.col("x"), 64)
    return V.lattice(spark, d).select("y", "x", v.alias("hv"), u.alias("hu"))


@query("prj25_tesseract", "SELECT i AS id, r, g, b, t, 4 * r + CASE WHEN r % 2 = 0 THEN g ELSE 3 - g END AS v, 4 * b + CASE WHEN b % 2 = 0 THEN t ELSE 3 - t END AS u FROM (SELECT i, i // 64 AS r, i // 16 % 4 AS g, i // 4 % 4 AS b, i % 4 AS t FROM range(256) q(i))")
def tesseract(spark, d):
    i = F.col("id")
    rows = spark.range(256).select("id", F.floor(i / 64).alias("r"), (F.floor(i / 16) % 4).alias("g"), (F.floor(i / 4) % 4).alias("b"), (i % 4).alias("t"))
    v, u = L.tesseract_place(F.col("r"), F.col("g"), F.col("b"), F.col("t"))
    placed = rows.withColumn("v", v).withColumn("u", u)
    back = L.tesseract_of(F.col("v"), F.col("u"))
    return placed.select("id", *[c.alias(n) for c, n in zip(back, "rgbt")], "v", "u")


@query("prj42_home_frame", "SELECT y, x, (y * 16 // 64) * 16 + x * 16 // 64 AS idx FROM range(64) a(y), range(64) b(x)")
def home_frame(spark, d):
    """The frame in which every site names its own patch."""
    rows = spark.range(4096).select(F.floor(F.col("id") / 64).alias("y"), (F.col("id") % 64).alias("x"))
    v, u = L.home(F.col("y"), F.col("x"), 64)
    return rows.select("y", "x", (v * 16 + u).alias("idx"))


@query("agg11_home_share", f"WITH {V.lattice_sql(64)} SELECT cycle, avg(CAST(v % 256 = (y * 16 // 64) * 16 + x * 16 // 64 AS INTEGER)) AS home_share FROM lattice GROUP BY cycle")
def home_share(spark, d):
    from rungwise.operators import indexstats as I

    return I.home_share(V.lattice(spark, d).withColumn("idx", F.col("v") % 256), 64, ["cycle"])


@query("agg33_centroids", f"WITH {V.lattice_sql(64)} SELECT cycle, v % 256 AS idx, avg(x) AS x, avg(y) AS y FROM lattice GROUP BY 1, 2")
def centroids(spark, d):
    from rungwise.operators import indexstats as I

    return I.centroids(V.lattice(spark, d).withColumn("idx", F.col("v") % 256), ["cycle"])


@query("jn11_own_patch", f"WITH {V.lattice_sql(64)} SELECT y, x, v FROM lattice WHERE v % 256 = (y * 16 // 64) * 16 + x * 16 // 64")
def own_patch(spark, d):
    v, u = L.home(F.col("y"), F.col("x"), 64)
    return V.lattice(spark, d).filter(F.col("v") % 256 == v * 16 + u).select("y", "x", "v")


@query("seq1_plain_walk", f"""WITH {PR}, {SITES} SELECT t.y, t.x, arg_min(p.idx, ROW({D2}, p.idx)) AS idx, t.y * 64 + CASE WHEN t.y % 2 = 0 THEN t.x ELSE 63 - t.x END AS emitted FROM sites t JOIN palette p
ON abs(p.idx // 16 - t.y * 16 // 64) <= 1 AND abs(p.idx % 16 - t.x * 16 // 64) <= 1 GROUP BY t.y, t.x""")
def plain_walk(spark, d):
    """Without carried errors the walk is a windowed choice in serpentine order."""
    palette, _ = V.probes(spark, d)
    got = P.window_choice(sites(spark, d), palette, 64, 1)
    return got.select("y", "x", "idx", L.serpentine_key(F.col("y"), F.col("x"), 64).alias("emitted"))


@query("agg23_fidelity", f"WITH {Q16}, e AS (SELECT id % 7 AS rung, sqrt(CAST(a * a + b * b AS DOUBLE)) AS de, row_number() OVER (PARTITION BY id % 7 ORDER BY a * a + b * b) - 1 AS r, count(*) OVER (PARTITION BY id % 7) AS n FROM q16) SELECT rung, max(de) AS most, max(CASE WHEN r = CAST(floor(n * 0.95::DOUBLE) AS BIGINT) THEN de END) AS p95 FROM e GROUP BY rung")
def fidelity(spark, d):
    from rungwise.operators import statistics as S

    zero = [F.lit(0).cast("long")] * 2
    e = q16(spark, d).select((F.col("id") % 7).alias("rung"), C.delta([F.col("a"), F.col("b")], zero).alias("de"))
    p95 = S.ordered_pick(e, ["rung"], "de", 0.95, "p95")
    return e.groupBy("rung").agg(F.max("de").alias("most")).join(p95, "rung")
