"""lodegraph: typed document graphs, graph-aware retrieval and its evaluation, on Spark DataFrames."""
