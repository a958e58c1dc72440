"""mirrorline: offline-mirror dataflow for captured web corpora, on Spark.

Every job takes and returns DataFrames; every per-row rule is a Column
expression built from ``pyspark.sql.functions`` so it runs inside the JVM.
"""

__version__ = "0.1.0"
