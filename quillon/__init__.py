"""Signal and cohort analytics on PySpark."""
