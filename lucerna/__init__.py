"""A PySpark-native semantic analytics engine: models, measures and filter contexts compiled to DataFrames."""
