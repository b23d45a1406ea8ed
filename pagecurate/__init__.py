"""pagecurate — corpus curation and segment classification on Spark.

Every public operator is a plain function ``DataFrame -> DataFrame`` (use it
with ``df.transform``) or a column expression built from
``pyspark.sql.functions``.
"""

__version__ = "0.1.0"
