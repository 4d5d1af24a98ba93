"""zetasky: a PySpark-native engine for integrated three-point shear statistics on pixelised spheres."""
