"""Golden values, brute force and properties of the sky statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zetasky.functions import geometry, healpix
from zetasky.operators import aperture, density, discs, pairs, xi
from zetasky.operators.zeta import zeta
from zetasky.plans.engine import Correlation
from zetasky.plans.params import Params
from zetasky.sources import fixture, tables

SF = "/root/testdata/sf0.001"
SMALL = Params(nside=16, nbins=3, theta_min=150.0, theta_max=1400.0, patch_size=900.0, theta_q=300.0, filter_radius=800.0)


def row(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


@pytest.mark.parametrize("nside", [1, 2, 3, 16])
def test_pixelisation_round_trip(spark, nside):
    sky = healpix.pixels(spark, nside)
    back = sky.select("pix", "z", healpix.sky_to_pixel(F.col("ra"), math.pi / 2 - F.col("dec"), nside).alias("back")).toPandas()
    assert (back.pix == back.back).all() and len(back) == 12 * nside**2
    assert abs(back.z.sum()) < 1e-9 and healpix.pixel_area(nside) * len(back) == pytest.approx(4 * math.pi)


def test_filter_golden_values(spark):
    q = lambda t: geometry.compensated_filter(F.lit(t), 90.0)
    t = geometry.arcmin(90)
    got = row(spark, a=q(t), b=q(t * math.sqrt(2)), c=q(1.0), lo=q(t * 1.40), hi=q(t * 1.43))
    assert got.a == pytest.approx(70.42156004344751) and got.b == pytest.approx(85.42567054229009)
    assert got.c >= 0 and got.b > got.lo and got.b > got.hi


def test_angles_and_phases(spark):
    z = F.lit(0.0)
    assert row(spark, a=geometry.angle_at(z, z, F.lit(math.pi / 2), z)).a == pytest.approx(math.pi / 2)
    for (ra, dec), want in {(0.0, 0.1): (-1, 0), (0.1, 0.0): (1, 0), (1e-4, 1e-4): (0, 1)}.items():
        got = row(spark, **geometry.pair_phases(z, z, F.lit(ra), F.lit(dec)))
        assert (got.e1_re, got.e1_im) == pytest.approx(want, abs=1e-6)
    ends = [F.rand(1) * 6, F.rand(2) * 2.8 - 1.4, F.rand(3) * 6, F.rand(4) * 2.8 - 1.4]
    names = ["a", "b", "c", "d"]
    points = spark.range(300).select(*(e.alias(n) for e, n in zip(ends, names, strict=True))).persist()
    one = points.select(*(c.alias(k) for k, c in geometry.pair_phases(*map(F.col, names)).items())).toPandas()
    two = points.select(*(c.alias(k) for k, c in geometry.pair_phases(*map(F.col, ["c", "d", "a", "b"])).items())).toPandas()
    assert np.allclose(one.e1_re**2 + one.e1_im**2, 1) and np.allclose(one.e2_re**2 + one.e2_im**2, 1)
    assert np.allclose(one.e1_re, two.e2_re) and np.allclose(one.e1_im, two.e2_im)
    t = math.pi / 2 - points.select(geometry.angle_at(*map(F.col, names)).alias("t")).toPandas().t
    assert np.allclose(one.e1_re, np.cos(2 * t)) and np.allclose(one.e1_im, np.sin(2 * t))


@pytest.mark.parametrize("change", [{"nside": 0}, {"nbins": 0}, {"theta_min": 200.0}, {"patch_size": 0}, {"theta_q": -1}, {"theta_min": 0.0}, {"filter_radius": 0}])
def test_bad_parameters(change):
    with pytest.raises(ValueError):
        Params(**{"nside": 8, **change})


def test_bad_lists(spark):
    with pytest.raises(ValueError):
        tables.patches_from_lists(spark, [0.0], [0.0, 1.0])
    with pytest.raises(ValueError):
        tables.mask_from_list(spark, [1] * 100, Params(nside=8))
    with pytest.raises(ValueError):
        xi.correlate(None, None, None, None, None, mode="other")


def test_bin_edges():
    want = [20, 24.7726, 30.6841, 38.0063, 47.0758, 58.3095, 72.2240, 89.4588, 110.8065, 137.2483, 170]
    assert [math.degrees(e) * 60 for e in Params(nside=8, theta_min=20).edges()] == pytest.approx(want, abs=1e-4)


def test_pair_counts_of_a_fine_sky(spark):
    phi, theta = 0.17180582, 1.55334303
    params = Params(nside=64, theta_min=20, theta_max=170)
    centre = tables.patches_from_lists(spark, [phi], [theta])
    got = Correlation(spark, params, centre).counts().toPandas().sort_values("bin").npairs.tolist()
    sky = healpix.pixels(spark, 64).toPandas()
    p = np.array([math.sin(theta) * math.cos(phi), math.sin(theta) * math.sin(phi), math.cos(theta)])
    v = sky[["x", "y", "z"]].to_numpy()
    v = v[v @ p >= math.cos(geometry.arcmin(90))]
    d = np.arccos(np.clip(v @ v.T, -1, 1))[np.triu_indices(len(v), 1)]
    assert got == np.histogram(d, params.edges())[0].tolist()


def test_aperture_mass_golden(spark):
    filters = spark.createDataFrame([(0, i, 1.0 - i * 0.5, 0.5 * i, 1.0) for i in range(3)], "patch_id int, pix long, q_cos double, q_sin double, q_val double")
    shear = spark.createDataFrame([(0, 0, i, 0.01 * (i + 1), 0.02 * i, 1.0) for i in range(3)], "map_id int, zbin int, pix long, g1 double, g2 double, w double")
    area = 3 * healpix.pixel_area(8)
    gt = [-0.01 * (i + 1) * (1 - i * 0.5) - 0.02 * i * 0.5 * i for i in range(3)]
    assert aperture.aperture_mass(filters, shear, Params(nside=8)).first().m_ap == pytest.approx(area * sum(gt) / 3)
    lacking = shear.filter("pix < 2")  # a pixel without a field counts in the area alone
    assert aperture.aperture_mass(filters, lacking, Params(nside=8)).first().m_ap == pytest.approx(area * sum(gt[:2]) / 2)


def golden_xi(spark, **options):
    table = spark.createDataFrame([(0, 0, 0, 2, 1.0, 0.0, 1.0, 0.0), (0, 0, 1, 3, 1.0, 0.0, 1.0, 0.0)], "patch_id int, bin int, pix1 long, pix2 long, e1_re double, e1_im double, e2_re double, e2_im double")
    g1, g2 = [0.01, 0.02, 0.03, 0.04], [0.015, 0.015, 0.025, 0.025]
    shear = spark.createDataFrame([(0, z, i, g1[i] * (1 + z), g2[i] * (1 - 2 * z), 1.0 + z * i) for z in (0, 1) for i in range(4)], "map_id int, zbin int, pix long, g1 double, g2 double, w double")
    members = spark.createDataFrame([(0, i) for i in range(4)], "patch_id int, pix long")
    sums = xi.accumulate(table.withColumn("part", F.lit(0)), xi.patch_fields(members, shear), 2, weighted=options.get("weighted", True))
    zpairs, bins = xi.zbin_pairs(shear.select("zbin").distinct()), spark.createDataFrame([(0,), (1,)], "bin int")
    return {(r.z1, r.z2, r.bin): r for r in xi.correlate(sums, members.select("patch_id").distinct(), bins, zpairs, shear.select("map_id").distinct(), **options).collect()}


def test_xi_modes_and_empty_bins(spark):
    weighted, plain, ahead = golden_xi(spark), golden_xi(spark, weighted=False), golden_xi(spark, mode="forward")
    want = [(0.01 * 0.03 + 0.015 * 0.025), (0.02 * 0.04 + 0.015 * 0.025)]
    assert plain[0, 0, 0].xip == pytest.approx(sum(want) / 2) and weighted[0, 0, 0].xip == pytest.approx(plain[0, 0, 0].xip)
    assert plain[0, 0, 1].xip is None and weighted[0, 0, 1].xim is None and weighted[0, 0, 1].npairs == 0
    a = [((0.01 * (0.03 * 2) - 0.015 * 0.025), 3), ((0.02 * 0.08 - 0.015 * 0.025), 4)]
    b = [((0.03 * (0.01 * 2) - 0.015 * 0.025), 1), ((0.04 * 0.04 - 0.015 * 0.025), 2)]
    mean = lambda terms: sum(v * w for v, w in terms) / sum(w for _, w in terms)
    assert ahead[0, 1, 0].xip == pytest.approx(mean(a)) and weighted[0, 1, 0].xip == pytest.approx((mean(a) + mean(b)) / 2)
    assert ahead[0, 1, 0].sumw == 7 and weighted[0, 1, 0].sumw == 10


def test_zeta_golden(spark):
    masses = spark.createDataFrame([(0, 0, p, m) for p, m in enumerate((1.0, 2.0, 4.0))], "map_id int, zbin int, patch_id int, m_ap double")
    x = spark.createDataFrame([(0, 0, 0, p, 0, v, -v) for p, v in enumerate((1.0, 3.0, 2.0))], "map_id int, z1 int, z2 int, patch_id int, bin int, xip double, xim double")
    got = zeta(masses, x).first()
    assert got.zetap == pytest.approx(1 / 3) and got.zetam == pytest.approx(-1 / 3)
    assert zeta(masses.withColumn("m_ap", F.lit(2.0)), x).first().zetap == pytest.approx(0)
    holed = x.withColumn("xip", F.when(F.col("patch_id") > 0, F.col("xip")))
    assert zeta(masses, holed).first().zetap == pytest.approx(-0.5) and zeta(masses, holed, strict=True).first().zetap is None
    counts = [xi.zbin_triples(spark.range(n).select(F.col("id").alias("zbin"))).count() for n in range(1, 6)]
    assert counts == [1, 4, 10, 20, 35]


def test_salt_store_and_mask_change_nothing(spark, tmp_path):
    centres = fixture.patches(spark, SF).filter("patch_id < 6")
    mask = spark.range(SMALL.npix).select(F.col("id").alias("pix"), F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("id") % 4 * 1.0).alias("m"))
    plain, salted = Correlation(spark, SMALL, centres, mask), Correlation(spark, SMALL, centres, mask, salt=3)
    table = lambda c: sorted(map(tuple, c.pairs.select("patch_id", "bin", "pix1", "pix2").collect()))
    assert table(plain) == table(salted)
    assert all(p % 5 and p % 4 for r in table(plain) for p in r[2:])
    plain.save_pairs(str(tmp_path / "store"))
    some = Correlation.load_pairs(spark, str(tmp_path / "store"), 2, 5)
    assert some.params == SMALL and table(some) == [(p - 2, *r) for p, *r in table(plain) if 2 <= p < 5]
    plan = some.pairs._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(home,2), LessThan(home,5)" in plan
    assert "Python" not in plain.aperture_mass(fixture_shear(spark))._jdf.queryExecution().toString()
    whole, parted = (table_of_xi(c.xi(fixture_shear(spark))) for c in (plain, salted))
    salted.save_pairs(str(tmp_path / "salted"), buckets=7)
    again = table_of_xi(Correlation.load_pairs(spark, str(tmp_path / "salted")).xi(fixture_shear(spark)))
    shared = table_of_xi(Correlation(spark, SMALL, centres, mask, overlapping=True).xi(fixture_shear(spark)))
    assert whole == parted == again == shared


def table_of_xi(found):
    return {tuple(r)[:6]: tuple(x if x is None else float(f"{x:.9e}") for x in tuple(r)[6:]) for r in found.collect()}


def fixture_shear(spark):
    i = F.col("id")
    return spark.range(SMALL.npix).select(F.lit(0).alias("map_id"), (i % 2).cast("int").alias("zbin"), i.alias("pix"), (F.sin(i * 0.7) * 0.01).alias("g1"), (F.cos(i * 1.3) * 0.01).alias("g2"), (1 + i % 3).cast("double").alias("w"))


def test_whole_measurement_equals_numpy(spark):
    centres = fixture.patches(spark, SF).filter("patch_id in (3, 7)")
    shear = fixture_shear(spark)
    engine = Correlation(spark, SMALL, centres)
    got = {(r.z1, r.z2, r.patch_id, r.bin): (r.xip, r.xim) for r in engine.xi(shear).collect()}
    masses = {(r.zbin, r.patch_id): r.m_ap for r in engine.aperture_mass(shear).collect()}
    sky, s = healpix.pixels(spark, SMALL.nside).toPandas(), shear.toPandas().set_index("pix")
    v, edges = sky[["x", "y", "z"]].to_numpy(), SMALL.edges()
    for c in centres.collect():
        p = np.array([math.sin(c.theta_center) * math.cos(c.phi_center), math.sin(c.theta_center) * math.sin(c.phi_center), math.cos(c.theta_center)])
        inside = np.flatnonzero(v @ p >= math.cos(geometry.arcmin(SMALL.patch_size)))
        sums = {}
        for n, i in enumerate(inside):
            for j in inside[n + 1 :]:
                k = np.searchsorted(edges, math.acos(max(-1, min(1, v[i] @ v[j])))) - 1
                if not 0 <= k < SMALL.nbins:
                    continue
                east = np.cross([0, 0, 1], v[i])

                def field(a, b):  # shear rotated so that its real part lies along the arc to the other pixel
                    east = np.cross([0, 0, 1], v[a]) / np.linalg.norm(np.cross([0, 0, 1], v[a]))
                    north = np.cross(v[a], east)
                    t = math.atan2(v[b] @ north, v[b] @ east)
                    return complex(s.g1[a], s.g2[a]) * complex(math.cos(2 * t), math.sin(2 * t)), s.zbin[a], s.w[a]

                assert east.any()
                (x, zx, wx), (y, zy, wy) = field(i, j), field(j, i)
                entry = sums.setdefault((min(zx, zy), max(zx, zy), k), {})
                total = entry.setdefault(zx <= zy, [0, 0, 0])
                for q, term in enumerate((wx * wy * (x * y.conjugate()).real, wx * wy * (x * y).real, wx * wy)):
                    total[q] += term
        for (z1, z2, k), entry in sums.items():
            want = [np.mean([t[q] / t[2] for t in entry.values()]) for q in (0, 1)]
            assert got[z1, z2, c.patch_id, k] == pytest.approx(want, rel=1e-6, abs=1e-10)
    assert len(masses) == 4 and all(math.isfinite(m) for m in masses.values())


def test_degrade_and_discs(spark):
    flat = spark.range(healpix.npix(8)).select(F.col("id").alias("pix"), F.lit(2.5).alias("v"))
    got = healpix.degrade(flat, 8, 2, "v").toPandas()
    assert len(got) == 48 and (got.v == 2.5).all()
    centres = fixture.patches(spark, SF)
    for radius in (200.0, 3000.0, 12000.0):
        sky = healpix.pixels(spark, 16)
        cell = {(r.patch_id, r.pix) for r in discs.in_discs(sky, centres, radius, 16).collect()}
        v, p = sky.toPandas(), centres.toPandas()
        points = np.stack([np.sin(p.theta_center) * np.cos(p.phi_center), np.sin(p.theta_center) * np.sin(p.phi_center), np.cos(p.theta_center)])
        inside = v[["x", "y", "z"]].to_numpy() @ points >= math.cos(geometry.arcmin(radius))
        assert cell == {(int(b), int(a)) for a, b in zip(*np.nonzero(inside), strict=True)}


def test_histograms(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 900), [4.0]])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, rng.normal(2, 3, 901), strict=True)], "x double, y double")
    y = df.toPandas().y.to_numpy()
    grid = np.zeros((30, 30), dtype=int)
    for r in density.hist2d(df, "x", "y", 30).collect():
        grid[r.ix, r.iy] = r["count"]
    assert (grid == np.histogram2d(x, y, bins=30)[0]).all()
    counts, edges = np.histogram(x, bins="auto")
    got = density.hist1d_density(df, "x").toPandas().sort_values("bin")
    assert got["count"].tolist() == counts.tolist() and np.allclose(got.density, counts / 901 / np.diff(edges))
    top = density.marginal_summary(df, "x").first()
    assert top["mode"] == pytest.approx((edges[counts.argmax()] + edges[counts.argmax() + 1]) / 2) and top["std"] == pytest.approx(x.std())
    smooth = density.smooth_grid(density.hist2d(df, "x", "y", 30), 30)
    assert smooth.agg(F.sum("density")).first()[0] == pytest.approx(901)
    levels = {r.share: r.level for r in density.hpd_levels(smooth).collect()}
    assert levels[0.68] > levels[0.95] > levels[0.99]
    assert density.grid_centres(df, "x", 30).count() == 30


def test_pairs_of_far_points(spark):
    points = spark.createDataFrame([(0, i, 0.1 * i, 0.1 * i) for i in range(4)], "patch_id int, pix long, ra double, dec double")
    assert pairs.pairs(points, Params(nside=64)).count() == 0
    assert not tables.same_map(fixture_shear(spark), (0, 0), (0, 1)) and tables.same_map(fixture_shear(spark), (0, 1), (0, 1))


def test_quantiles_are_exact_in_bounded_passes(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=6000), np.full(4000, 0.5), rng.exponential(size=1000) * 1e6, [-1e300, 1e300]])
    df = spark.createDataFrame([(float(a),) for a in v] + [(None,)] * 50, "x double").repartition(5)
    shares = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    for most, accuracy in ((10_000, 10_000), (40, 100)):
        assert density.exact_quantiles(df, "x", shares, most, accuracy) == pytest.approx(list(np.quantile(v, shares)), rel=1e-12)
    assert density.exact_quantiles(df.filter("x is null"), "x", shares) is None
    assert density.exact_quantiles(df.filter("x = 0.5"), "x", (0.3,), 1, 10) == [0.5]
    assert density.hist1d_density(df.filter("x is null"), "x").count() == 0 and density.hist1d_density(df.filter("x = 0.5"), "x").count() == 1
    plan = density.hist1d_density(df, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_smoothing_of_narrow_grids_and_wide_kernels(spark):
    grid = np.arange(12).reshape(4, 3)
    counts = spark.createDataFrame([(i, j, int(grid[i, j])) for i in range(4) for j in range(3)], "ix int, iy int, count long")
    for sigma in (0.5, 3.0):
        got = density.smooth_grid(counts, 4, sigma)
        radius = int(4 * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
        square = np.zeros((4, 4))
        square[:, :3] = grid
        for axis in (0, 1):
            square = np.apply_along_axis(lambda line: np.convolve(np.pad(line, radius, mode="symmetric"), w / w.sum(), "valid"), axis, square)
        found = np.zeros((4, 4))
        for r in got.collect():
            found[r.ix, r.iy] = r.density
        assert np.allclose(found, square)


@pytest.mark.parametrize("n", [1, 2, 16])
def test_cells_hold_their_centres(spark, n):
    sky = healpix.pixels(spark, n).select("pix", "x", "y", "z", *(c.alias(k) for c, k in zip(healpix.sky_to_face(F.col("ra"), F.col("z"), n), ("face", "ix", "iy"), strict=True)))
    back = healpix.face_to_sky(F.col("face"), F.col("ix"), F.col("iy"), n)
    got = sky.select("*", *(c.alias(k) for c, k in zip(back, "XYZ", strict=True))).toPandas()
    assert len(got[["face", "ix", "iy"]].drop_duplicates()) == 12 * n * n
    assert np.allclose(got[list("xyz")], got[list("XYZ")])


def test_cover_is_bounded_and_joins_by_key(spark):
    centres = fixture.patches(spark, SF)
    found = discs.in_discs(healpix.pixels(spark, 64), centres, 60.0, 64)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    vectors = centres.select("patch_id", (F.sin("theta_center") * F.cos("phi_center")).alias("px"), (F.sin("theta_center") * F.sin("phi_center")).alias("py"), F.cos("theta_center").alias("pz"))
    for radius, n in ((0.5, 2), (0.1, 8), (0.01, 64), (0.001, 1024)):
        assert discs.covering_cells(vectors, radius, n).groupBy("patch_id").count().agg(F.max("count")).first()[0] <= 40


def test_neighbouring_cells_find_all_close_pairs(spark):
    close = Params(nside=32, nbins=3, theta_min=90.0, theta_max=260.0, patch_size=900.0)
    assert close.by_cells and not SMALL.by_cells
    members = discs.patch_pixels(healpix.pixels(spark, 32), fixture.patches(spark, SF).filter("patch_id < 4"), close)
    rows = lambda df: sorted(map(tuple, df.select("patch_id", "pix1", "pix2", "ra1", "dec2").collect()))
    near, every = pairs.near_pairs(members, geometry.arcmin(260.0)), pairs.candidate_pairs(members)
    d = geometry.separation(*(F.col(c) for c in pairs.ENDS))
    limit = geometry.arcmin(260.0)
    assert rows(near.filter(d <= limit)) == rows(every.filter(d <= limit))
    small, large, whole = near.count(), pairs.near_pairs(members, 2 * limit).count(), every.count()
    assert small < large / 2.5 and small < whole / 4  # grows with the square of the separation, not the patch's
    edge = spark.createDataFrame([(0, i, 0.7 * i, math.pi / 2 * (i % 3 - 1)) for i in range(9)], "patch_id int, pix long, ra double, dec double")
    assert pairs.near_pairs(edge, math.pi).count() == 36


def test_shared_pairs_are_the_patches_pairs(spark):
    members = discs.patch_pixels(healpix.pixels(spark, 16), fixture.patches(spark, SF), SMALL)
    shared = pairs.shared_pairs(members, SMALL)
    columns = ["patch_id", "bin", "pix1", "pix2"]
    plain, dealt = (sorted(map(tuple, df.select(*columns).collect())) for df in (pairs.pairs(members, SMALL), pairs.by_patch(shared)))
    assert plain == dealt and shared.count() == len({r[1:] for r in plain}) < len(plain)
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ACOS(") == 1 + plan.count("AS theta_center")


def test_running_mass_by_parts(spark):
    rng = np.random.default_rng(5)
    rows = [(k, i, j, float(v)) for k in ("a", "b") for i in range(20) for j in range(20) for v in [max(0, rng.integers(-5, 9 if k == "a" else 3))]]
    grid = spark.createDataFrame(rows, "k string, ix int, iy int, density double")
    for parts in (1, 5, 64):
        got = {tuple(r)[:3]: (r.mass, r.total) for r in density.running_mass(grid, ("k",), parts).collect()}
        for k in ("a", "b"):
            cells = sorted((-d, i, j) for key, i, j, d in rows if key == k and d > 0)
            sums = np.cumsum([-c[0] for c in cells])
            assert [got[k, i, j] for _, i, j in cells] == [(m, sums[-1]) for m in sums]
        assert len(got) == sum(d > 0 for *_, d in rows)
    plan = density.hpd_levels(grid.filter("k = 'a'").drop("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(density" not in plan
    assert density.hpd_levels(grid.filter("density < 0"), keys=("k",)).count() == 0
