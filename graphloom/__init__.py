"""Knowledge-graph analytics over collections of files, as Spark DataFrames."""
