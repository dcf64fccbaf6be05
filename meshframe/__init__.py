"""Partitioned array, matrix, graph, log and corpus analytics on Spark DataFrames."""
