"""millrace: a Spark-native engine for compiling and analysing text corpora."""

__version__ = "0.1.0"
