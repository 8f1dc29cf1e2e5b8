"""threadloom: conversation analytics expressed as Spark DataFrame plans."""
