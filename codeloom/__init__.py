"""codeloom: code-graph analytics as Spark DataFrames."""
