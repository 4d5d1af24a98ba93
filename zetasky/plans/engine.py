"""One object for a whole measurement: geometry once, then any number of maps."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zetasky.operators import aperture, discs, pairs, xi
from zetasky.operators.zeta import zeta
from zetasky.plans.params import Params
from zetasky.sources import store, tables


class Correlation:
    """Geometry of a footprint and patches, and the statistics of maps on it. All results are lazy DataFrames.

    ``overlapping`` patches share the geometry of the pairs that they have in common, which is then made once for all of them.
    """

    def __init__(self, spark: SparkSession, params: Params, centres: DataFrame, mask: DataFrame | None = None, salt: int | None = None, overlapping: bool = False):
        self.spark, self.params, self.centres, self.salt = spark, params, centres, salt or params.salt
        self.footprint = tables.footprint(spark, params, mask)
        self._cell_pairs = self._filters = None
        self._range, self.overlapping = (0, None), overlapping

    @cached_property
    def members(self) -> DataFrame:
        return discs.patch_pixels(self.footprint, self.centres, self.params)

    @property
    def cell_pairs(self) -> DataFrame:
        """Each pair once for all patches of a cell that hold it, with these ``patches``."""
        if self._cell_pairs is None:
            return pairs.cell_pairs(self.members, self.params, self.salt)
        start, stop = self._range
        if start <= 0 and stop is None:
            return self._cell_pairs
        wanted = F.filter("patches", lambda p: (p >= start) if stop is None else (p >= start) & (p < stop))
        return self._cell_pairs.withColumn("patches", F.transform(wanted, lambda p: p - start))

    @property
    def pairs(self) -> DataFrame:
        if self.overlapping:
            return pairs.by_patch(pairs.shared_pairs(self.members, self.params), self.salt)
        return pairs.by_patch(self.cell_pairs)

    def ends(self, fields: DataFrame) -> DataFrame:
        """Pairs with the rotated fields at both ends: gathered by pixel for pairs of a store, else paired with the fields."""
        if self._cell_pairs is not None:
            return xi.gathered_shear(self.pairs.drop("part"), fields)
        return xi.paired_shear(self.members, self.params, fields, self.salt)

    def sums(self, fields: DataFrame, weighted: bool = True, fields_too: bool = True) -> DataFrame:
        """Counts of pairs and their sums for every patch, cell by cell; pairs of a store stay in their buckets."""
        if self.overlapping:
            return xi.accumulate(self.pairs, xi.patch_fields(self.members, fields, self.salt), self.params.nbins, ("patch_id", "part"), weighted, fields_too)
        return xi.accumulate(*self._by_cell(fields), weighted, fields_too)

    def _by_cell(self, fields: DataFrame) -> tuple:
        """Pairs and fields of cells, the bins, and what both are dealt by."""
        stored = self._cell_pairs is not None
        found = self._cell_pairs if stored else pairs.cell_pairs(self.members, self.params, self.salt, held=False)
        keys = ("cell", "part") if stored or self.salt > 1 else ("cell",)
        return found, xi.patch_fields(self.members, fields, self.salt, ("cell",)), self.params.nbins, keys

    def end_sums(self, fields: DataFrame) -> DataFrame:
        """What ``ends`` gives, counted and summed for every map, patch, bin and (z at pix1, z at pix2), without a row for each pair."""
        found = xi.accumulate_ends(*self._by_cell(fields))
        if self.salt == 1:
            return found
        return found.groupBy("map_id", "patch_id", "bin", "za", "zb").agg(*(F.sum(c).alias(c) for c in ("n", *xi.END_SUMS)))

    @property
    def filters(self) -> DataFrame:
        if self._filters is None:
            self._filters = discs.filter_pixels(self.footprint, self.centres, self.params)
        return self._filters

    def save_pairs(self, path: str, buckets: int | None = None) -> None:
        store.save(path, self.params, self.salt, discs.with_cell(self.centres, self.params), self.members, self.cell_pairs, self.filters, self.footprint, buckets)

    @classmethod
    def load_pairs(cls, spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> Correlation:
        """The stored patches from ``start`` up to ``stop``, numbered from 0."""
        mask = spark.read.parquet(f"{path}/footprint").withColumn("m", F.lit(1.0))
        params, salt, buckets = store.load_params(spark, path)
        out = cls(spark, params, store.load(spark, path, "centres", start, stop), mask, salt)
        out._cell_pairs, out._filters, out.members = (store.load(spark, path, t, start, stop, buckets) for t in ("pairs", "filters", "members"))
        out._range = start, stop
        return out

    def counts(self) -> DataFrame:
        return pairs.pair_counts(self.pairs, self.centres, self.params)

    def aperture_mass(self, shear: DataFrame, flip_g1: bool = False) -> DataFrame:
        return aperture.aperture_mass(self.filters, tables.load_maps(shear, flip_g1), self.params)

    def weight_sums(self, shear: DataFrame) -> DataFrame:
        """Sums of weights for the ``norms`` of ``xi``, without reading the fields."""
        return xi.weight_sums(self.sums(shear, fields_too=False))

    def xi(self, shear: DataFrame, mode: str = "symmetric", weighted: bool = True, flip_g1: bool = False, zpairs: DataFrame | None = None, norms: DataFrame | None = None) -> DataFrame:
        fields = tables.load_maps(shear, flip_g1)
        zpairs = xi.zbin_pairs(shear.select("zbin").distinct()) if zpairs is None else zpairs
        return xi.correlate(self.sums(fields, weighted), self.centres, self.params.bins(self.spark), zpairs, shear.select("map_id").distinct(), mode, weighted, norms)

    def zeta(self, shear: DataFrame, flip_g1: bool = False, strict: bool = False, zpairs: DataFrame | None = None) -> DataFrame:
        return zeta(self.aperture_mass(shear, flip_g1), self.xi(shear, flip_g1=flip_g1, zpairs=zpairs), strict)
