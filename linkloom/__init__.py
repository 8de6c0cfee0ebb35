"""Link-graph, interval and window analytics on PySpark DataFrames."""
