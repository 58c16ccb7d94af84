"""geoloom: geometric graph clustering and corpus operators on PySpark DataFrames."""
