"""ledgerloom: paired-comparison analytics over a log of scored generations, on PySpark."""
