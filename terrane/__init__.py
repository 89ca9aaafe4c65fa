"""A Spark-native analytics engine for point, track, raster-sample and event data."""
