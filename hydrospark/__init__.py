"""Raster hydrology on Spark: cell tables in, channel networks out."""
