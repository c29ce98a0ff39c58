"""quillon: Spark-native fusion of image-frame, sensor-log and event-hit tables."""

__version__ = "0.1.0"
