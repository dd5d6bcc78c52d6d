"""Document de-identification and corpus analytics as Spark DataFrames."""
