"""faultlens: Spark-native cluster-observability and fault-dataset engine.

Every operator is a ``DataFrame -> DataFrame`` function (usable through
``DataFrame.transform``) built from Spark SQL expressions; see README.md.
"""

__version__ = "0.1.0"
