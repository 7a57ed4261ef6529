"""tessera: find, align, calibrate and merge overlapping sources with Spark DataFrames."""
