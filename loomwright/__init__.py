"""loomwright: a Spark-first analytics engine for dated, attributed text corpora."""
