"""Spark-native analytics for binary prediction markets.

Every operator is a lazy ``DataFrame -> DataFrame`` function.  Nothing in the
library collects rows to the driver.
"""
