"""markloom: markup-corpus analytics on Spark."""
