"""Binary analytics on Spark: byte and bit sequences held in DataFrames."""
