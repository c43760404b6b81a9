"""factloom: bi-temporal fact, graph and vector analytics as ordinary Spark DataFrames."""

__version__ = "0.1.0"
