"""Evidence retrieval, checking and evaluation over large text corpora on Spark."""
