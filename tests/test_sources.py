"""Files of patch centres, maps and masks; stored and fresh geometry; the pair stage's plan."""

import re

import numpy as np
import pytest

from zetasky.operators import xi
from zetasky.plans.engine import Correlation
from zetasky.plans.params import Params
from zetasky.sources import fixture, maps, tables

SF = "/root/testdata/sf0.001"


def test_centres_from_text_over_several_splits(spark, tmp_path):
    phi, theta = [0.001 * i for i in range(3000)], [0.0005 * i + 0.1 for i in range(3000)]
    (tmp_path / "phi").write_text("\n".join(f"{x:.25f}" for x in phi) + "\n\n")
    (tmp_path / "theta").write_bytes("\r\n".join(map(repr, theta)).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = tables.patches_from_text(spark, str(tmp_path / "phi"), str(tmp_path / "theta")).orderBy("patch_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.patch_id for r in got] == list(range(3000))
    assert [r.phi_center for r in got] == pytest.approx(phi) and [r.theta_center for r in got] == theta


def card(key, value):
    return f"{key:<8}= {value:>20}".ljust(80).encode()


def padded(data, fill=b"\0"):
    return data + fill * (-len(data) % 2880)


def fits(ordering, columns, rows):
    """A file with an image of two bytes and a table of columns (form, array of shape (rows, repeats))."""
    text = lambda v: f"'{v}'"
    first = [card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 1), card("NAXIS1", 2), b"END".ljust(80)]
    width = sum(v[0].nbytes for _, v in columns)
    head = [card("XTENSION", text("BINTABLE")), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", width), card("NAXIS2", rows), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(columns)), card("ORDERING", text(ordering))]
    head += [card(f"TFORM{i + 1}", text(form)) for i, (form, _) in enumerate(columns)] + [b"COMMENT = 'END'".ljust(80)] * 40 + [b"END".ljust(80)]
    data = b"".join(v[r].tobytes() for r in range(rows) for _, v in columns)
    return padded(b"".join(first), b" ") + padded(b"xy") + padded(b"".join(head), b" ") + padded(data)


def test_maps_from_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(maps, "BATCH", 100)
    values = np.linspace(-3, 3, 768)
    values[5] = np.nan
    read = lambda df: [r.m for r in df.orderBy("pix").collect()]
    np.save(tmp_path / "m.npy", values)
    np.save(tmp_path / "b.npy", values > 0)
    assert read(maps.map_from_npy(spark, str(tmp_path / "m.npy"))) == pytest.approx(values.tolist(), nan_ok=True)
    assert read(maps.map_from_npy(spark, str(tmp_path / "b.npy"))) == (values > 0).astype(float).tolist()
    columns = [("1024E".replace("1024", "96"), values.astype(">f4").reshape(8, 96)), ("96J", np.full(768, 7.0).astype(">f8").reshape(8, 96).astype(">i4")), ("96D", values.astype(">f8").reshape(8, 96))]
    (tmp_path / "m.fits").write_bytes(fits("RING", columns, 8))
    assert read(maps.map_from_fits(spark, str(tmp_path / "m.fits"))) == pytest.approx(values.tolist(), rel=1e-6, nan_ok=True)
    assert read(maps.map_from_fits(spark, str(tmp_path / "m.fits"), 2)) == pytest.approx(values.tolist(), nan_ok=True)
    kept = tables.kept(maps.map_from_fits(spark, str(tmp_path / "m.fits"), 2))
    assert kept.count() == 767
    parted = maps.map_from_fits(spark, str(tmp_path / "m.fits"), 2, values_a_task=200)
    assert parted.rdd.getNumPartitions() == 4 and read(parted) == pytest.approx(values.tolist(), nan_ok=True)
    assert maps.map_from_npy(spark, str(tmp_path / "m.npy"), 100).rdd.getNumPartitions() == 8
    two = maps.map_from_npy(spark, str(tmp_path / "b.npy")).join(maps.map_from_npy(spark, str(tmp_path / "m.npy"), 100).withColumnRenamed("m", "v"), "pix")
    assert two.filter("(m = 1) <> (v > 0 and not isnan(v))").count() == 0 and two.count() == 768
    (tmp_path / "n.fits").write_bytes(fits("NESTED", columns, 8))
    with pytest.raises(Exception, match="RING"):
        maps.map_from_fits(spark, str(tmp_path / "n.fits")).count()
    (tmp_path / "short.fits").write_bytes(fits("RING", columns, 8)[:-2880])
    with pytest.raises(Exception, match="ends within"):
        maps.map_from_fits(spark, str(tmp_path / "short.fits")).count()
    np.save(tmp_path / "square.npy", np.zeros((3, 3)))
    with pytest.raises(Exception, match="one dimension"):
        maps.map_from_npy(spark, str(tmp_path / "square.npy")).count()


def test_maps_of_another_store_are_read_whole(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(10.0))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.maps.link./far", f"file://{tmp_path}")
    got = maps.map_from_npy(spark, "viewfs://maps/far/m.npy")
    assert [r.m for r in got.orderBy("pix").collect()] == list(range(10))


def test_stored_pairs_and_known_norms_give_the_same(spark, tmp_path):
    plain = Correlation(spark, fixture.PARAMS, fixture.patches(spark, SF).filter("patch_id < 5"))
    plain.save_pairs(str(tmp_path / "store"))
    stored, shear = Correlation.load_pairs(spark, str(tmp_path / "store")), fixture.shear(spark, SF)
    table = lambda df: {tuple(r)[:5]: tuple(r)[5:] for r in df.collect()}
    own = lambda c: sorted(map(tuple, c.ends(shear).select("map_id", "patch_id", "bin", "pix1", "pix2", "za", "zb", "r1", "i2", "ww").collect()))
    for a, b in zip(own(plain), own(stored), strict=True):
        assert a[:7] == b[:7] and a[7:] == pytest.approx(b[7:], rel=1e-9, abs=1e-12)
    want = table(plain.xi(shear))
    for other in (stored.xi(shear), plain.xi(shear, norms=stored.weight_sums(shear)), Correlation.load_pairs(spark, str(tmp_path / "store"), 2, 4).xi(shear)):
        got = table(other)
        if len(got) < len(want):  # patches 2 and 3, numbered from 0
            want = {(*k[:3], k[3] - 2, *k[4:]): v for k, v in want.items() if 2 <= k[3] < 4}
        assert set(got) == set(want)
        for k, row in want.items():
            assert [x is None for x in got[k]] == [x is None for x in row]
            assert [x or 0 for x in got[k]] == pytest.approx([x or 0 for x in row], rel=1e-9, abs=1e-15)


def test_pair_stage_computes_a_separation_once_and_shuffles_pixels_only(spark, tmp_path):
    fixture.patches(spark, SF).write.parquet(str(tmp_path / "centres"))
    fixture.shear(spark, SF).write.parquet(str(tmp_path / "shear"))
    plain = Correlation(spark, fixture.PARAMS, spark.read.parquet(str(tmp_path / "centres")))
    plan = plain.ends(spark.read.parquet(str(tmp_path / "shear")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ACOS(") == 1
    above = plan[: plan.index("ACOS(")]
    assert "Exchange" not in above and "Join" not in above
    assert not re.search(r"hashpartitioning\(pix[12]#", plan)


def test_stored_pairs_are_summed_in_their_buckets(spark, tmp_path):
    plain = Correlation(spark, fixture.PARAMS, fixture.patches(spark, SF))
    plain.save_pairs(str(tmp_path / "store"))
    assert len(list((tmp_path / "store" / "pairs").glob("*.parquet"))) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored, shear = Correlation.load_pairs(spark, str(tmp_path / "store"), 2), fixture.shear(spark, SF)
    plan = stored.xi(shear)._jdf.queryExecution().executedPlan().toString()
    pairs_side = plan[plan.index("FlatMapCoGroupsInArrow") :]
    pairs_side = pairs_side[: pairs_side.index("FileScan")]
    assert "Exchange" not in pairs_side and "Bucketed: true" in plan
    sums = stored.sums(shear)._jdf.queryExecution().optimizedPlan().toString()
    assert sums.count("Generate") == 0  # no row for each redshift pair of a pair


def test_a_measurement_makes_its_pairs_once(spark, tmp_path):
    fixture.patches(spark, SF).write.parquet(str(tmp_path / "centres"))
    fixture.shear(spark, SF).write.parquet(str(tmp_path / "shear"))
    engine = Correlation(spark, fixture.PARAMS, spark.read.parquet(str(tmp_path / "centres")))
    plan = engine.zeta(spark.read.parquet(str(tmp_path / "shear")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1
    assert len(re.findall(r"pix#\d+L? < pix#\d+L?|pix1#\d+L? < pix2#\d+L?", plan)) == 1
    assert plan.count("CartesianProduct") == 0


def test_salt_grows_with_the_patch():
    assert Params(nside=512, theta_min=20).salt == 1 < Params(nside=4096, theta_min=20, patch_size=180).salt
