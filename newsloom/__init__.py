"""newsloom: DataFrame-native analytics over news corpora on Apache Spark."""

__version__ = "0.1.0"
