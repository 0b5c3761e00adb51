"""tracewright: store, search, restore and prepare semi-structured text on Spark."""
