"""linkloom: document cross-reference analytics expressed as Spark DataFrame plans."""
