"""A PySpark-native engine for classifying and analysing 3-D point clouds."""
