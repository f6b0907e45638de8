"""jobsight: job-market analytics on Spark DataFrames.

Subpackages: ``functions`` (Column rules), ``sources``/``sinks`` (I/O),
``operators`` (DataFrame -> DataFrame), ``plans`` (composed queries and the
query catalog), ``streaming`` (Structured Streaming jobs).
"""
