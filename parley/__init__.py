"""parley: a Spark-first analytics engine for annotated multi-party dialogue."""
