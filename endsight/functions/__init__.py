"""Column expressions. Every function takes and returns ``pyspark.sql.Column``."""
