"""graphloom: graph analytics and table processing expressed with Spark DataFrames."""
