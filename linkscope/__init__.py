"""linkscope: link-graph and text-relevance analytics on Spark DataFrames."""
