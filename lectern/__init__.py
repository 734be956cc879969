"""A document-retrieval analytics engine on PySpark."""
