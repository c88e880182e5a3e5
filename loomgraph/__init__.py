"""Code-graph analytics on Spark DataFrames, and corpus preparation in ``loomgraph.llm``."""

__version__ = "0.1.0"
