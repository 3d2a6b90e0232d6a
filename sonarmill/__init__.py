"""sonarmill: a PySpark-native engine for labelled recording datasets."""

__version__ = "0.1.0"
