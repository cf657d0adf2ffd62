"""gridloom: raster-scan analytics as Spark DataFrame operators."""
