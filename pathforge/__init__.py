"""Critical-path analytics over weighted DAGs as PySpark DataFrames."""
