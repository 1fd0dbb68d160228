"""gridloom: a Spark-first engine for drawing extraction tables and text corpora."""
