"""staylens: Spark-native tabular price analytics.

Cleaning, exploration, feature encoding, model fitting, segmentation and
evaluation of listing tables, expressed as Spark DataFrame plans and
pyspark.ml stages.  Every public function takes and returns DataFrames
(or fitted pyspark.ml models); rows never travel through the driver.
"""

__version__ = "0.1.0"
