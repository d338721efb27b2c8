"""Vector analytics on Spark: distances, exact and approximate nearest neighbours, product
quantisation, proximity graphs, and readers and writers of binary vector files."""

__version__ = "0.1.0"
