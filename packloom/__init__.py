"""packloom: Spark-first selection, cleaning, tracing and packing of source trees and text corpora."""

__version__ = "0.1.0"
