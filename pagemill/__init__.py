"""pagemill: document-translation pipelines and their analytics on Spark."""
