"""Analytics over Debian-style package repositories, on Spark DataFrames."""
