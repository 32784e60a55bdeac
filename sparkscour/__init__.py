"""sparkscour: clean, check, de-duplicate and split messy tables with Spark DataFrame plans."""
