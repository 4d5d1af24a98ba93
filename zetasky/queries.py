"""The sky-statistics queries and their SQL twins.

Results are scaled and rounded, so that the last digits of floating-point sums do not matter to a comparison.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zetasky.functions import geometry, healpix
from zetasky.operators import aperture, contours, density, discs, pairs, xi
from zetasky.plans.engine import Correlation
from zetasky.plans.oracle import e, pixel_at, sql
from zetasky.sources import fixture, store, tables
from zetasky.sources.fixture import PARAMS

QUERIES, ORACLES = {}, {}
NSIDE = PARAMS.nside
ANGLE, MASS, XI, ZETA = (1.0, 9), (1e6, 3), (1e8, 3), (1e10, 3)
#: For means of few decimals, whose next digit may be a 5 with nothing behind it but what the order of a sum leaves.
MEAN = (0.9876543210123, 9)


def query(oracle: str):
    def register(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, oracle
        return fn

    return register


def r(column, scale: tuple[float, int], name: str) -> Column:
    return (F.round((F.col(column) if isinstance(column, str) else column) * scale[0], scale[1]) + 0.0).alias(name)


def rs(expression: str, scale: tuple[float, int], name: str) -> str:
    return f"round(({expression})*{e(scale[0])},{scale[1]})+0e0 as {name}"


def engine(spark: SparkSession, sf_dir: str) -> Correlation:
    return Correlation(spark, PARAMS, fixture.patches(spark, sf_dir))


# --- sources


@query(sql(f"select pix, {rs('ra', ANGLE, 'ra')}, {rs('dec', ANGLE, 'dec')} from pixels where pix in (select pix from mask where m<>0)", "pixels", "mask"))
def scan_pixels(spark, sf_dir):
    return tables.footprint(spark, PARAMS, fixture.mask(spark, sf_dir)).select("pix", r("ra", ANGLE, "ra"), r("dec", ANGLE, "dec"))


@query(sql(f"select patch_id, {rs('phi_center', ANGLE, 'phi_center')}, {rs('theta_center', ANGLE, 'theta_center')} from patches", "patches"))
def scan_patches(spark, sf_dir):
    return fixture.patches(spark, sf_dir).select("patch_id", r("phi_center", ANGLE, "phi_center"), r("theta_center", ANGLE, "theta_center"))


@query(sql(f"select map_id, zbin, pix, {rs('-g1', ANGLE, 'g1')}, {rs('g2', ANGLE, 'g2')}, {rs('w', ANGLE, 'w')} from shear", "shear"))
def load_maps(spark, sf_dir):
    return tables.load_maps(fixture.shear(spark, sf_dir)).select("map_id", "zbin", "pix", *(r(c, ANGLE, c) for c in ("g1", "g2", "w")))


def _store(spark: SparkSession, sf_dir: str) -> str:
    """A stored geometry in the shared folder; it goes when the driver ends, since results are read from it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = os.path.join(shared or tempfile.gettempdir(), f"zetasky-pairs-{uuid.uuid4().hex}")
    store.delete_at_exit(spark, path)
    engine(spark, sf_dir).save_pairs(path)
    return path


@query(sql("select patch_id, bin, count(*) as npairs, sum(pix1) as pix1, sum(pix2) as pix2, " + rs("sum(e1_re+e2_im)", ANGLE, "phase") + " from pairs group by 1,2", "pairs"))
def pairs_roundtrip(spark, sf_dir):
    stored = Correlation.load_pairs(spark, _store(spark, sf_dir)).pairs
    return stored.groupBy("patch_id", "bin").agg(F.count("*").alias("npairs"), F.sum("pix1").alias("pix1"), F.sum("pix2").alias("pix2"), r(F.sum(F.col("e1_re") + F.col("e2_im")), ANGLE, "phase"))


@query(sql("select cast(patch_id-5 as int) as patch_id, bin, count(*) as npairs from pairs where patch_id>=5 and patch_id<12 group by 1,2", "pairs"))
def load_pairs_range(spark, sf_dir):
    return Correlation.load_pairs(spark, _store(spark, sf_dir), 5, 12).pairs.groupBy("patch_id", "bin").agg(F.count("*").alias("npairs"))


@query(sql(f"select map_id, zbin, {pixel_at('ra', 'pi()/2-dec', 8)} as pix, {rs('avg(g1)', MEAN, 'g1')} from shear join pixels using (pix) group by 1,2,3", "shear", "pixels"))
def degrade_map(spark, sf_dir):
    return healpix.degrade(fixture.shear(spark, sf_dir), NSIDE, 8, "g1", "map_id", "zbin").select("map_id", "zbin", "pix", r("g1", MEAN, "g1"))


# --- scalar functions


@query(sql(f"select pix, {rs('ra', ANGLE, 'ra')}, {rs('dec', ANGLE, 'dec')} from pixels where pix in (select pix from shear)", "pixels", "shear"))
def pixel_to_radec(spark, sf_dir):
    phi, theta = healpix.pixel_to_sky(F.col("pix"), NSIDE)
    return fixture.shear(spark, sf_dir).select("pix").distinct().select("pix", r(phi, ANGLE, "ra"), r(math.pi / 2 - theta, ANGLE, "dec"))


@query(sql(f"select patch_id, {rs('sin(theta_center)*cos(phi_center)', ANGLE, 'x')}, {rs('sin(theta_center)*sin(phi_center)', ANGLE, 'y')}, {rs('cos(theta_center)', ANGLE, 'z')} from patches", "patches"))
def ang_to_vec(spark, sf_dir):
    at = fixture.patches(spark, sf_dir).select("patch_id", F.col("phi_center").alias("ra"), (math.pi / 2 - F.col("theta_center")).alias("dec"))
    return healpix.with_vector(at).select("patch_id", *(r(c, ANGLE, c) for c in "xyz"))


@query(sql("select patch_id, center_pix as pix from snapped", "snapped"))
def ang_to_pix(spark, sf_dir):
    return discs.snapped(fixture.patches(spark, sf_dir), PARAMS).select("patch_id", F.col("center_pix").alias("pix"))


LINE = "l_orderkey, l_linenumber"
ENDS_OF_LINE = ("ra1", "dec1", "ra2", "dec2")


def _of_lines(spark, sf_dir, **columns):
    return fixture.points(spark, sf_dir).select("l_orderkey", "l_linenumber", *(r(c, ANGLE, k) for k, c in columns.items()))


@query(sql(f"select {LINE}, {rs('cos(dec1)*cos(ra1)', ANGLE, 'x')}, {rs('cos(dec1)*sin(ra1)', ANGLE, 'y')}, {rs('sin(dec1)', ANGLE, 'z')} from points", "points"))
def radec_to_xyz(spark, sf_dir):
    return _of_lines(spark, sf_dir, **dict(zip("xyz", geometry.radec_to_xyz(F.col("ra1"), F.col("dec1")), strict=True)))


@query(sql(f"select {LINE}, {rs('atan2(cos(dec1)*cos(dec2)*sin(ra2-ra1), sin(dec2)-sin(dec1)*(cos(ra1-ra2)*cos(dec1)*cos(dec2)+sin(dec1)*sin(dec2)))', ANGLE, 'angle')} from points", "points"))
def spherical_angle(spark, sf_dir):
    return _of_lines(spark, sf_dir, angle=geometry.angle_at(*map(F.col, ENDS_OF_LINE)))


@query(sql(f"select {LINE}, {rs('acos(greatest(-1e0,least(1e0,cos(ra1-ra2)*cos(dec1)*cos(dec2)+sin(dec1)*sin(dec2))))', ANGLE, 'd')} from points", "points"))
def angular_separation(spark, sf_dir):
    return _of_lines(spark, sf_dir, d=geometry.separation(*map(F.col, ENDS_OF_LINE)))


PHASES = ("e1_re", "e1_im", "e2_re", "e2_im")


@query(sql("select patch_id, bin, pix1, pix2, " + ", ".join(rs(c, (1.0, 7), c) for c in PHASES) + " from pairs", "pairs"))
def pair_phase(spark, sf_dir):
    shared = engine(spark, sf_dir).cell_pairs.select("patches", "part", "bin", "pix1", "pix2", *(r(c, (1.0, 7), c) for c in PHASES))  # rounded once for all patches
    return pairs.by_patch(shared).select("patch_id", "bin", "pix1", "pix2", *PHASES)


@query(sql(f"select patch_id, pix, {rs('q_cos', (1.0, 7), 'q_cos')}, {rs('q_sin', (1.0, 7), 'q_sin')}, {rs('q_val', (1.0, 7), 'q_val')} from filters", "filters"))
def filter_geometry(spark, sf_dir):
    return engine(spark, sf_dir).filters.select("patch_id", "pix", *(r(c, (1.0, 7), c) for c in ("q_cos", "q_sin", "q_val")))


@query(sql(f"select {LINE}, {rs('theta*theta/(4*pi()*pow(radians(15e-1),4))*exp(-theta*theta/(2*pow(radians(15e-1),2)))', (1.0, 8), 'q')} from points", "points"))
def compensated_filter(spark, sf_dir):
    return fixture.points(spark, sf_dir).select("l_orderkey", "l_linenumber", r(geometry.compensated_filter(F.col("theta"), 90.0), (1.0, 8), "q"))


_E = PARAMS.edges()
_BINS = "(values " + ", ".join(f"(cast({i} as int), {e(a)}, {e(b)})" for i, (a, b) in enumerate(zip(_E, _E[1:], strict=False))) + ") t(bin, lo, hi)"


@query(sql(f"select bin, round(lo,9) as lo, round(hi,9) as hi, round(sqrt(lo*hi)*180/pi()*60,6) as center_arcmin, count(theta) as n from {_BINS} left join points on theta>lo and theta<hi group by bin, lo, hi", "points"))
def theta_bins(spark, sf_dir):
    """The bins, with the lines whose angle lies in each."""
    counted = fixture.points(spark, sf_dir).groupBy(PARAMS.bin_of(F.col("theta")).alias("bin")).agg(F.count("*").alias("n"))
    bins = PARAMS.bins(spark).join(counted, "bin", "left")
    return bins.select("bin", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), F.round("center_arcmin", 6).alias("center_arcmin"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(sql(f"select map_id, zbin, patch_id, pix, {rs('-g1*q_cos-g2*q_sin', ANGLE, 'gt')} from filters join shear using (pix)", "filters", "shear"))
def tangential_shear(spark, sf_dir):
    gt = geometry.tangential(*(F.col(c) for c in ("g1", "g2", "q_cos", "q_sin")))
    return engine(spark, sf_dir).filters.join(fixture.shear(spark, sf_dir), "pix").select("map_id", "zbin", "patch_id", "pix", r(gt, ANGLE, "gt"))


@query(sql(f"select map_id, zbin, pix, {rs('g1', ANGLE, 'g1')}, {rs('-g2', ANGLE, 'g2')} from shear", "shear"))
def flip_shear(spark, sf_dir):
    return tables.load_maps(fixture.shear(spark, sf_dir), False, True).select("map_id", "zbin", "pix", r("g1", ANGLE, "g1"), r("g2", ANGLE, "g2"))


@query(sql("select map_id, zbin, n_pix, min(map_id) over (partition by fields) as same_map, min(zbin) over (partition by fields) as same_zbin from (select cast(map_id+again as int) as map_id, zbin, count(*) as n_pix, list((pix,g1,g2,w) order by pix) as fields from shear join (values (0),(3)) t(again) on zbin<2 or again=0 group by 1,2)", "shear"))
def equal_maps(spark, sf_dir):
    """The maps and copies of some of them under other numbers: which are equal."""
    again = F.explode(F.when(F.col("zbin") < 2, F.array(F.lit(0), F.lit(fixture.N_MAPS))).otherwise(F.array(F.lit(0))))
    copied = fixture.shear(spark, sf_dir).withColumn("again", again).withColumn("map_id", (F.col("map_id") + F.col("again")).cast("int"))
    return tables.equal_maps(copied)


ENDS = ("r1", "i1", "r2", "i2")


@query(sql("select map_id, patch_id, bin, za, zb, " + ", ".join(rs(f"sum({c})", ANGLE, c) for c in ENDS) + " from ends group by 1,2,3,4,5", "ends"))
def rotate_shear(spark, sf_dir):
    """Fields rotated at both ends of every pair, summed for each bin."""
    return engine(spark, sf_dir).end_sums(fixture.shear(spark, sf_dir)).select("map_id", "patch_id", "bin", "za", "zb", *(r(c, ANGLE, c) for c in ENDS))


# --- filters, joins and set operations


@query(sql("select pix from mask where m<>0", "mask"))
def mask_filter(spark, sf_dir):
    return tables.kept(fixture.mask(spark, sf_dir))


@query(sql("select patch_id, pix from disc", "disc"))
def query_disc(spark, sf_dir):
    return discs.in_discs(healpix.pixels(spark, NSIDE), fixture.patches(spark, sf_dir), PARAMS.filter_radius, NSIDE).select("patch_id", "pix")


@query(sql("select patch_id, pix from members where pix in (select pix from mask where m<>0)", "members", "mask"))
def disc_semi_mask(spark, sf_dir):
    return discs.patch_pixels(tables.footprint(spark, PARAMS, fixture.mask(spark, sf_dir)), fixture.patches(spark, sf_dir), PARAMS).select("patch_id", "pix")


@query(sql("select patch_id, pix from filters", "filters"))
def disc_anti_center(spark, sf_dir):
    return engine(spark, sf_dir).filters.select("patch_id", "pix")


def _near(spark, sf_dir):
    return pairs.candidate_pairs(discs.patch_pixels(healpix.pixels(spark, NSIDE), fixture.patches(spark, sf_dir), PARAMS))


@query(sql("select patch_id, pix1, pix2, bin from binned", "binned"))
def assign_bin(spark, sf_dir):
    d = geometry.separation(*(F.col(c) for c in ("ra1", "dec1", "ra2", "dec2")))
    return _near(spark, sf_dir).select("patch_id", "pix1", "pix2", PARAMS.bin_of(d).alias("bin"))


@query(sql("select patch_id, pix from members", "members"))
def patch_pixels(spark, sf_dir):
    return discs.patch_pixels(healpix.pixels(spark, NSIDE), fixture.patches(spark, sf_dir), PARAMS).select("patch_id", "pix")


@query(sql("select patch_id, count(*) as n, sum(pix1) as pix1, sum(pix2) as pix2 from candidates group by 1", "candidates"))
def pair_join(spark, sf_dir):
    return _near(spark, sf_dir).groupBy("patch_id").agg(F.count("*").alias("n"), F.sum("pix1").alias("pix1"), F.sum("pix2").alias("pix2"))


@query(sql("select patch_id, bin, pix1, pix2 from pairs", "pairs"))
def pair_bins(spark, sf_dir):
    return engine(spark, sf_dir).pairs.select("patch_id", "bin", "pix1", "pix2")


@query(sql("select bin, pix1, pix2, list_sort(list(patch_id)) as patches from pairs group by 1,2,3", "pairs").replace("list_sort(list(patch_id)) as patches", "array_to_string(list_sort(list(patch_id)), ',') as patches, " + ", ".join(rs(f"any_value({c})", (1.0, 7), c) for c in PHASES)))
def shared_pairs(spark, sf_dir):
    """Each pair once, with the patches that hold it."""
    found = pairs.shared_pairs(engine(spark, sf_dir).members, PARAMS)
    return found.select("bin", "pix1", "pix2", F.concat_ws(",", F.transform("patches", lambda p: p.cast("string"))).alias("patches"), *(r(c, (1.0, 7), c) for c in PHASES))


CLOSE = replace(PARAMS, theta_min=90.0, theta_max=260.0, nbins=3)
_CE = CLOSE.edges()
_CLOSE_BIN = "case " + " ".join(f"when d>{e(a)} and d<{e(b)} then {i}" for i, (a, b) in enumerate(zip(_CE, _CE[1:], strict=False))) + " end"


@query(sql(f"select * from (select patch_id, cast({_CLOSE_BIN} as int) as bin, pix1, pix2 from candidates) where bin is not null", "candidates"))
def close_pairs(spark, sf_dir):
    """Pairs whose greatest separation is small beside the patch, by neighbouring cells."""
    close = Correlation(spark, CLOSE, fixture.patches(spark, sf_dir))
    return close.pairs.select("patch_id", "bin", "pix1", "pix2")


@query(sql(f"select map_id, patch_id, bin, za, zb, count(*) as n, {rs('sum(ww)', (1.0, 3), 'ww')} from ends group by 1,2,3,4,5", "ends"))
def pair_shear(spark, sf_dir):
    return engine(spark, sf_dir).end_sums(fixture.shear(spark, sf_dir)).select("map_id", "patch_id", "bin", "za", "zb", "n", r("ww", (1.0, 3), "ww"))


def _zbins(spark, sf_dir):
    return fixture.shear(spark, sf_dir).select("zbin").distinct()


@query(sql("select z1, z2 from zpairs", "zpairs"))
def zbin_pairs(spark, sf_dir):
    return xi.zbin_pairs(_zbins(spark, sf_dir))


@query(sql("select a.z1, a.z2, b.z2 as z3 from zpairs a join zpairs b on a.z2=b.z1", "zpairs"))
def zbin_triples(spark, sf_dir):
    return xi.zbin_triples(_zbins(spark, sf_dir))


@query(sql("select patch_id, pix from members intersect select patch_id, pix from patches cross join mask where m<>0", "members", "mask"))
def pix_intersect(spark, sf_dir):
    """Patches' pixels that are observed: a semi join on the pixel, whose rows carry their patch."""
    return patch_pixels(spark, sf_dir).join(tables.kept(fixture.mask(spark, sf_dir)), "pix", "left_semi").select("patch_id", "pix")


@query(sql("select patch_id, pix from members except select patch_id, pix from patches cross join mask where m<>0", "members", "mask"))
def pix_except(spark, sf_dir):
    return patch_pixels(spark, sf_dir).join(tables.kept(fixture.mask(spark, sf_dir)), "pix", "left_anti").select("patch_id", "pix")


# --- aggregations


@query(sql("select patch_id, bin, npairs from counts", "counts"))
def pair_counts(spark, sf_dir):
    return engine(spark, sf_dir).counts()


@query(sql("select patch_id, bin, npairs, cast(sum(npairs) over (partition by patch_id order by bin rows unbounded preceding)-npairs as bigint) as first from counts", "counts"))
def bin_offsets(spark, sf_dir):
    return pairs.bin_offsets(engine(spark, sf_dir).counts())


@query(sql(f"select patch_id, n_pix, {rs('area', ANGLE, 'area')} from areas", "areas"))
def filter_area(spark, sf_dir):
    return discs.filter_area(engine(spark, sf_dir).filters, PARAMS).select("patch_id", "n_pix", r("area", ANGLE, "area"))


@query(sql(f"select map_id, zbin, patch_id, {rs('m_ap', MASS, 'm_ap')} from masses", "masses"))
def aperture_mass(spark, sf_dir):
    """Of filters that are given, not those of an engine."""
    found = aperture.aperture_mass(discs.filter_pixels(healpix.pixels(spark, NSIDE), fixture.patches(spark, sf_dir), PARAMS), fixture.shear(spark, sf_dir), PARAMS)
    return found.select("map_id", "zbin", "patch_id", r("m_ap", MASS, "m_ap"))


def _xi_sql(plus: str, minus: str, where: str = "true") -> str:
    return sql(f"select map_id, z1, z2, patch_id, bin, npairs, {rs(plus, XI, 'xip')}, {rs(minus, XI, 'xim')} from xi where {where}", "xi")


def _xi(spark, sf_dir, **options):
    out = engine(spark, sf_dir).xi(fixture.shear(spark, sf_dir), **options)
    return out.select("map_id", "z1", "z2", "patch_id", "bin", "npairs", r("xip", XI, "xip"), r("xim", XI, "xim"))


@query(_xi_sql("fp", "fm", "z1=z2"))
def xi_auto(spark, sf_dir):
    return _xi(spark, sf_dir, zpairs=_zbins(spark, sf_dir).selectExpr("zbin as z1", "zbin as z2"))


@query(_xi_sql("xip", "xim", "z1<z2"))
def xi_cross(spark, sf_dir):
    return _xi(spark, sf_dir, zpairs=xi.zbin_pairs(_zbins(spark, sf_dir)).filter("z1 < z2"))


@query(_xi_sql("xip", "xim"))
def xi_weighted(spark, sf_dir):
    """With sums of weights that were found before, as maps with the same weights would share them."""
    maps = fixture.shear(spark, sf_dir)
    return _xi(spark, sf_dir, norms=engine(spark, sf_dir).weight_sums(maps))


@query(sql(f"select map_id, z1, z2, patch_id, bin, {rs('fw', (1.0, 3), 'sumw')} from xi", "xi"))
def sum_of_weights(spark, sf_dir):
    out = engine(spark, sf_dir).xi(fixture.shear(spark, sf_dir), mode="forward")
    return out.select("map_id", "z1", "z2", "patch_id", "bin", r("sumw", (1.0, 3), "sumw"))


@query(sql(f"select map_id, zbin, patch_id, {rs('m_ap', MASS, 'm_ap')} from masses", "masses"))
def full_tomo_map(spark, sf_dir):
    return engine(spark, sf_dir).aperture_mass(fixture.shear(spark, sf_dir)).select("map_id", "zbin", "patch_id", r("m_ap", MASS, "m_ap"))


@query(sql(f"select map_id, z1, z2, patch_id, bin, npairs, {rs('sumw', (1.0, 3), 'sumw')}, {rs('xip', XI, 'xip')}, {rs('xim', XI, 'xim')} from xi", "xi"))
def stored_tomo_xi(spark, sf_dir):
    """As ``full_tomo_xi``, of a stored geometry: its pairs are read where they lie."""
    out = Correlation.load_pairs(spark, _store(spark, sf_dir)).xi(fixture.shear(spark, sf_dir))
    return out.select("map_id", "z1", "z2", "patch_id", "bin", "npairs", r("sumw", (1.0, 3), "sumw"), r("xip", XI, "xip"), r("xim", XI, "xim"))


@query(sql(f"select map_id, z1, z2, patch_id, bin, npairs, {rs('sumw', (1.0, 3), 'sumw')}, {rs('xip', XI, 'xip')}, {rs('xim', XI, 'xim')} from xi", "xi"))
def full_tomo_xi(spark, sf_dir):
    out = engine(spark, sf_dir).xi(fixture.shear(spark, sf_dir))
    return out.select("map_id", "z1", "z2", "patch_id", "bin", "npairs", r("sumw", (1.0, 3), "sumw"), r("xip", XI, "xip"), r("xim", XI, "xim"))


@query(sql(f"select map_id, z1, z2, patch_id, bin, npairs, {rs('fw', (1.0, 3), 'sumw')}, {rs('fp', XI, 'xip')}, {rs('fm', XI, 'xim')} from xi", "xi"))
def xi_forward(spark, sf_dir):
    out = engine(spark, sf_dir).xi(fixture.shear(spark, sf_dir), mode="forward")
    return out.select("map_id", "z1", "z2", "patch_id", "bin", "npairs", r("sumw", (1.0, 3), "sumw"), r("xip", XI, "xip"), r("xim", XI, "xim"))


_PLAIN = "(select map_id, least(za,zb) as z1, greatest(za,zb) as z2, patch_id, bin, sum(r1*r2+i1*i2) as p, sum(r1*r2-i1*i2) as m from ends group by all)"


@query(sql(f"select map_id, z1, z2, patch_id, bin, npairs, {', '.join(rs(f'coalesce({c},0)/nullif(npairs,0)/case when z1=z2 then 1 else 2 end', XI, name) for c, name in (('p', 'xip'), ('m', 'xim')))} from grid left join {_PLAIN} using (map_id,z1,z2,patch_id,bin)", "grid", "ends"))
def xi_unweighted(spark, sf_dir):
    out = engine(spark, sf_dir).xi(fixture.shear(spark, sf_dir), weighted=False)
    return out.select("map_id", "z1", "z2", "patch_id", "bin", "npairs", r("xip", XI, "xip"), r("xim", XI, "xim"))


@query(sql(f"select map_id, z1, bin, {rs('zetap', ZETA, 'zetap')}, {rs('zetam', ZETA, 'zetam')} from zetas where z1=z3", "zetas"))
def zeta(spark, sf_dir):
    """Every map with all of its parts in one redshift bin."""
    found = engine(spark, sf_dir).zeta(fixture.shear(spark, sf_dir), zpairs=_zbins(spark, sf_dir).selectExpr("zbin as z1", "zbin as z2"))
    return found.filter("z1 = z3").select("map_id", "z1", "bin", r("zetap", ZETA, "zetap"), r("zetam", ZETA, "zetam"))


@query(sql(f"select map_id, z1, z2, z3, bin, {rs('zetap', ZETA, 'zetap')}, {rs('zetam', ZETA, 'zetam')} from zetas", "zetas"))
def zeta_tomo(spark, sf_dir):
    return engine(spark, sf_dir).zeta(fixture.shear(spark, sf_dir)).select("map_id", "z1", "z2", "z3", "bin", r("zetap", ZETA, "zetap"), r("zetam", ZETA, "zetam"))


# --- density summaries


def _samples(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


@query(sql("select ix, iy, n as count from cells", "cells"))
def hist2d(spark, sf_dir):
    return density.hist2d(_samples(spark, sf_dir), "x", "y", 20)


@query(sql(f"select ix, iy, {rs('density', (1.0, 6), 'density')} from smooth", "smooth"))
def smooth_grid(spark, sf_dir):
    return density.smooth_grid(hist2d(spark, sf_dir), 20).select("ix", "iy", r("density", (1.0, 6), "density"))


@query(sql(f"select share, {rs('max(density)', (1.0, 6), 'level')} from (select density, sum(density) over (order by density desc, ix, iy rows unbounded preceding) as mass, sum(density) over () as total from smooth) join (values (99e-2),(95e-2),(68e-2)) s(share) on mass>share*total group by 1", "smooth"))
def hpd_levels(spark, sf_dir):
    return density.hpd_levels(density.smooth_grid(hist2d(spark, sf_dir), 20)).select("share", r("level", (1.0, 6), "level"))


CORNER = ("l_quantity", "l_extendedprice", "l_discount")
TRUTH = {"l_quantity": 25.0, "l_extendedprice": 40000.0, "l_discount": 0.05}


def _lines(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*CORNER)


def _each_pair(needs: str, query) -> str:
    """The union of ``query(x, y)`` over the pairs of a corner, each with the expressions of its own samples."""
    pairs = [(x, y) for i, x in enumerate(CORNER) for y in CORNER[i + 1 :]]
    return " union all ".join("(" + sql(query(x, y), needs, samples=f"select {x} as x, {y} as y from lineitem where {x} is not null and {y} is not null") + ")" for x, y in pairs)


@query(_each_pair("cells", lambda x, y: f"select '{x}' as x, '{y}' as y, ix, iy, n as count from cells"))
def corner_hist2d(spark, sf_dir):
    return density.corner_hist2d(_lines(spark, sf_dir), CORNER, 20)


_LEVELS = "(select share, max(density) as level from (select density, sum(density) over (order by density desc, ix, iy rows unbounded preceding) as mass, sum(density) over () as total from smooth) join (values (99e-2),(95e-2),(68e-2)) s(share) on mass>share*total group by 1)"


def _contours(x: str, y: str) -> str:
    cell = lambda c, n: f"(select cast(least(floor(({e(TRUTH[c])}-min({n}))/(max({n})-min({n}))*20),19) as int) from samples)"
    return f"select '{x}' as x, '{y}' as y, ix, iy, {rs('density', (1.0, 6), 'density')}, min(share) filter (where density>=level) as inside, ix={cell(x, 'x')} and iy={cell(y, 'y')} as is_truth from smooth cross join {_LEVELS} group by ix, iy, density"


@query(_each_pair("smooth", _contours))
def contour_table(spark, sf_dir):
    found = density.contour_table(_lines(spark, sf_dir), CORNER, 20, truth=TRUTH)
    return found.select("x", "y", "ix", "iy", r("density", (1.0, 6), "density"), "inside", "is_truth")


_PADDED = "(select i.i as ix, j.i as iy, coalesce(density, 0) as density from (select unnest(range(-1, 21)) as i) i cross join (select unnest(range(-1, 21)) as i) j left join smooth s on s.ix=i.i and s.iy=j.i)"
_CROSSED = " union all ".join(
    f"select share, {rs('a.ix' + (f'+{part}' if dx else ''), (1.0, 6), 'px')}, {rs('a.iy' + (f'+{part}' if dy else ''), (1.0, 6), 'py')} from {_PADDED} a join {_PADDED} b on b.ix=a.ix+{dx} and b.iy=a.iy+{dy} join {_LEVELS} l on (a.density>=level)<>(b.density>=level)"
    for dx, dy in ((1, 0), (0, 1))
    for part in ("(level-a.density)/(b.density-a.density)",)
)


@query(sql(_CROSSED, "smooth"))
def contour_curves(spark, sf_dir):
    """The points of the closed curves around the densest regions, in cells of the grid."""
    grid = density.smooth_grid(hist2d(spark, sf_dir), 20)
    return contours.curves(grid, density.hpd_levels(grid)).select("share", r("px", (1.0, 6), "px"), r("py", (1.0, 6), "py"))


@query(sql("select cast(k.range as int) as ix, " + rs("lo+(k.range+5e-1)*(hi-lo)/20", (1.0, 6), "center") + " from range(20) k, (select min(y) as lo, max(y) as hi from samples)", "samples"))
def grid_centres(spark, sf_dir):
    return density.grid_centres(_samples(spark, sf_dir), "y", 20).select("ix", r("center", (1.0, 6), "center"))


@query(sql(f"select bin, {rs('center', (1.0, 6), 'center')}, count, {rs('density', (1e6, 6), 'density')} from hist1d", "hist1d"))
def hist1d_density(spark, sf_dir):
    return density.hist1d_density(_samples(spark, sf_dir), "y").select("bin", r("center", (1.0, 6), "center"), "count", r("density", (1e6, 6), "density"))


@query(sql(f"select {rs('(select center from hist1d order by count desc, bin limit 1)', (1.0, 6), 'mode')}, {rs('(select stddev_pop(y) from samples)', (1.0, 4), 'std')}", "hist1d"))
def marginal_summary(spark, sf_dir):
    return density.marginal_summary(_samples(spark, sf_dir), "y").select(r("mode", (1.0, 6), "mode"), r("std", (1.0, 4), "std"))
