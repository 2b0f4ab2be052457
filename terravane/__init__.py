"""terravane: a Spark-native engine for geospatial anomalies and territorial intelligence."""

__version__ = "0.1.0"
