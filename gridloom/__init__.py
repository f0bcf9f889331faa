"""Gridloom: raster, manifest and corpus analytics on Spark DataFrames."""
