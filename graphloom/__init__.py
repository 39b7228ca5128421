"""graphloom: property-graph queries compiled to Spark DataFrames."""
