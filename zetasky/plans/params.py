"""Measurement parameters and angular bins."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zetasky.functions import healpix
from zetasky.functions.geometry import arcmin


#: Pairs of pixels that one task looks at, and that a worker holds when their fields are summed.
PAIRS_A_TASK = 4_000_000
#: A cell of the sky reaches at most this over its resolution in radians from its centre.
CELL_REACH = 1.1


@dataclass(frozen=True)
class Params:
    """Separations, radii and scales are in arcmin; ``patch_size`` and ``filter_radius`` are radii of discs."""

    nside: int
    nbins: int = 10
    theta_min: float = 10.0
    theta_max: float = 170.0
    patch_size: float = 90.0
    theta_q: float = 90.0
    filter_radius: float = 450.0

    def __post_init__(self):
        for name in ("nside", "nbins", "patch_size", "theta_q", "filter_radius", "theta_min"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")
        if not self.theta_min < self.theta_max:
            raise ValueError("theta_min must be less than theta_max")

    @property
    def npix(self) -> int:
        return healpix.npix(self.nside)

    @property
    def cell_level(self) -> int:
        """Resolution of the cells of the sky whose patches share their pairs: a cell reaches over half of a patch's radius at most."""
        half = min(math.pi, arcmin(self.patch_size)) / 2
        return 1 << max(0, min(20, math.ceil(math.log2(CELL_REACH / half))))

    @property
    def salt(self) -> int:
        """Tasks over which the pairs of a cell's patches are spread, so that each has some PAIRS_A_TASK to look at."""
        members = self.npix * (1 - math.cos(min(math.pi, arcmin(self.patch_size) + CELL_REACH / self.cell_level))) / 2
        return max(1, math.ceil(members * members / 2 / PAIRS_A_TASK))

    @property
    def by_cells(self) -> bool:
        """Whether cells of edge theta_max and their neighbours are less than half of a patch."""
        edge = 2 * math.sin(min(math.pi, arcmin(self.theta_max)) / 2)
        return 9 * edge * edge < math.pi * (1 - math.cos(min(math.pi, arcmin(self.patch_size))))

    def edges(self) -> list[float]:
        """Logarithmic bin edges in radians."""
        lo, hi = arcmin(self.theta_min), arcmin(self.theta_max)
        return [lo * (hi / lo) ** (i / self.nbins) for i in range(self.nbins)] + [hi]

    def bins(self, spark: SparkSession) -> DataFrame:
        """bin, lo, hi (radians), center_arcmin: a few rows."""
        e = self.edges()
        rows = [(i, e[i], e[i + 1], math.degrees(math.sqrt(e[i] * e[i + 1])) * 60) for i in range(self.nbins)]
        return spark.createDataFrame(rows, "bin int, lo double, hi double, center_arcmin double")

    def bin_of(self, distance: Column) -> Column:
        """Bin number of a separation, null outside; bins are open at both ends."""
        e = self.edges()
        chain = F
        for i in range(self.nbins):
            chain = chain.when((distance > e[i]) & (distance < e[i + 1]), F.lit(i))
        return chain

    def as_row(self) -> dict:
        return asdict(self)


def check_centres(phi: list[float], theta: list[float]) -> None:
    if len(phi) != len(theta):
        raise ValueError("phi and theta of patch centres must have the same length")


def check_mask_length(mask: list | None, params: Params) -> None:
    if mask is not None and len(mask) != params.npix:
        raise ValueError(f"the mask must have {params.npix} entries")
