"""Queries that take every patch, map and redshift pair, against their SQL and brute force."""

import math

import numpy as np
import pytest

import __spark_entry__
from zetasky import queries
from zetasky.functions import geometry, healpix
from zetasky.sources import fixture

SF = "/root/testdata/sf0.001"


def both(spark, name):
    """Sorted pandas frames of a query and of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in ("lineitem", "supplier", "orders"):
        db.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    want = db.execute(__spark_entry__.oracle_sql()[name]).df()[list(got.columns)]
    order = [c for c in got.columns if got[c].dtype.kind in "iu" or c == "bin"]
    return (f.sort_values(order).reset_index(drop=True) for f in (got, want))


def check_twin(spark, name):
    got, want = both(spark, name)
    assert len(got) == len(want)
    for c in got.columns:
        assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=2e-3 if c in ("xip", "xim") else 2e-6, equal_nan=True), c
    return got


PATCHED = ("pair_phase", "assign_bin", "rotate_shear", "pix_intersect", "pix_except")


@pytest.mark.parametrize("name", PATCHED)
def test_every_patch_passes(spark, name):
    assert set(check_twin(spark, name).patch_id) == {r.patch_id for r in fixture.patches(spark, SF).collect()}


@pytest.mark.parametrize("name", ["degrade_map", "tangential_shear", "rotate_shear", "pair_shear", "xi_unweighted", "xi_forward"])
def test_every_map_and_redshift_passes(spark, name):
    got = check_twin(spark, name)
    z = next(c for c in ("zbin", "z1", "za") if c in got)
    other = {"z1": "z2", "za": "zb"}.get(z, z)
    n, every = fixture.N_ZBINS, range(fixture.N_ZBINS)
    pairs = {"zbin": n, "z1": n * (n + 1) // 2, "za": n * n}[z]
    assert set(got.map_id) == set(range(fixture.N_MAPS)) and set(got[z]) == set(got[other]) == set(every)
    assert len(got[["map_id", z, other] if z != other else ["map_id", z]].drop_duplicates()) == fixture.N_MAPS * pairs


def test_discs_and_sets_by_brute_force(spark):
    v, p = healpix.pixels(spark, queries.NSIDE).toPandas().sort_values("pix"), fixture.patches(spark, SF).toPandas()
    points = np.stack([np.sin(p.theta_center) * np.cos(p.phi_center), np.sin(p.theta_center) * np.sin(p.phi_center), np.cos(p.theta_center)])
    inside = v[["x", "y", "z"]].to_numpy() @ points >= math.cos(geometry.arcmin(queries.PARAMS.patch_size))
    want = {(int(b), int(a)) for a, b in zip(*np.nonzero(inside), strict=True)}
    found = lambda name: {tuple(r) for r in queries.QUERIES[name](spark, SF).select("patch_id", "pix").collect()}
    assert found("patch_pixels") == want
    kept = {r.pix for r in fixture.mask(spark, SF).collect() if r.m}
    assert found("pix_intersect") == {x for x in want if x[1] in kept} and found("pix_except") == {x for x in want if x[1] not in kept}


def test_corner_tables(spark):
    got = {name: {tuple(r)[:4]: tuple(r)[4:] for r in queries.QUERIES[name](spark, SF).collect()} for name in ("corner_hist2d", "contour_table")}
    db = pytest.importorskip("duckdb").connect()
    db.execute(f"create view lineitem as select * from read_parquet('{SF}/lineitem.parquet')")
    for name, rows in got.items():
        found = queries.QUERIES[name](spark, SF).columns
        want = {tuple(r)[:4]: tuple(r)[4:] for r in db.execute(f"select {', '.join(found)} from ({queries.ORACLES[name]})").fetchall()}
        assert rows == want
    contours = got["contour_table"]
    assert len(contours) == 3 * 400 and sum(r[2] for r in contours.values()) == 3
    assert {r[1] for r in contours.values()} == {None, 0.99, 0.95, 0.68}
    assert sum(r[0] for r in got["corner_hist2d"].values()) == 3 * spark.read.parquet(f"{SF}/lineitem.parquet").count()
