"""fidelis: Spark-native fidelity checks for candidate (synthetic / resampled) tables.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects and takes
column names as arguments; nothing data-sized is collected to the driver.
"""

__version__ = "0.1.0"
