"""Raster, point-cloud and estimation operators over Spark DataFrames."""
