"""SQL front-end in plain Python: tokens, tree, canonical text, metadata. It imports nothing of Spark."""
