"""A numerical analytics engine on PySpark: arrays, matrices and vectors as index-keyed DataFrames."""
