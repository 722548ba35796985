"""Column-level functions built from Spark SQL expressions."""
