"""graphloom: a PySpark-native analytics engine over typed code graphs and corpora."""

__version__ = "0.1.0"
