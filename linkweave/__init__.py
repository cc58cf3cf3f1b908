"""linkweave: link-graph extraction, resolution and all-shortest-paths search on Spark DataFrames."""
