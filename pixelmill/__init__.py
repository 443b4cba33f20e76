"""pixelmill: raster analytics on PySpark.

Images are relations of pixels ``(image_id, y, x, r, g, b, a)`` with bigint samples of 0 to 255, or dense rows with the
samples in one binary.  Operators compile to declarative queries that Catalyst optimises; see :class:`pixelmill.raster.Raster`.
"""
