"""strandkg: knowledge-graph retrieval and record processing as Spark DataFrames."""

__version__ = "0.1.0"
