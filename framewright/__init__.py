"""framewright: integer frame compression and sensor-data analytics on Spark DataFrames."""
