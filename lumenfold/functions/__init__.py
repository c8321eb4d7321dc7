"""Column functions whose semantics differ from Spark's built-ins of like names; the rest is pyspark.sql.functions."""
