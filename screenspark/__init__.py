"""screenspark: candidate screening, ranking and corpus preparation as Spark plans."""
