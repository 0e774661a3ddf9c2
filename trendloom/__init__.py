"""Topic and trend analytics over dated documents, as Spark DataFrame operators."""
