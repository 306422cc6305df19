"""Spark-native analytics for very large collections of weekly surveillance series.

Every operator is a function from DataFrame to DataFrame over long tables keyed by
``series_id``; nothing here loops over series on the driver.
"""
