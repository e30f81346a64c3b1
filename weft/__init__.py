"""weft: text to a weighted graph of concepts and relations, and queries on it, as Spark DataFrame operators."""
