"""docflow: a PySpark-native analytics engine for machine-read documents."""

__version__ = "0.1.0"
