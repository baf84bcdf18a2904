"""Question answering over a fact graph, and corpus preparation, on Spark."""
