"""tessella: a Spark-native engine for gridded features, label rasters and text corpora."""

__version__ = "0.1.0"
