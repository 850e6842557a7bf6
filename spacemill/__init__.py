"""Space-management analytics on PySpark."""
