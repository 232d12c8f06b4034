"""arborlight: code-graph analytics and change gating on PySpark DataFrames."""

__version__ = "0.1.0"
