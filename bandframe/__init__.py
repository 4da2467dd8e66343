"""Surface-water raster analytics on Spark: a raster is a table of pixels."""

__version__ = "0.1.0"
