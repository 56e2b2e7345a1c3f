"""wristloom: analytics of body-worn motion-sensor recordings on Apache Spark.

Operators are functions from DataFrames to DataFrames.  They take the names of the key (recording), time
and value columns, so they run on any table with such columns, for all recordings at once.
"""
