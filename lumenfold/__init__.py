"""lumenfold: federated-style analytics on PySpark.

Execution is left to Catalyst and the scheduler; this package adds what Spark lacks, as plan rewrites, column
expressions with documented semantics, and DataFrame helpers.
"""
