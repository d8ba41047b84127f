"""Feature assembly, classifiers, calibration and attribution on pyspark.ml."""
