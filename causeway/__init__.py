"""Causeway: stability and validity audits of root-cause attributions, on Spark DataFrames."""
