"""seqbucket: collections of short sequencing reads as Spark DataFrames."""

__version__ = "0.1.0"
