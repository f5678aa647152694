"""slotweave: a PySpark-native engine for blockchain change events and training-data pipelines."""

__version__ = "0.1.0"
