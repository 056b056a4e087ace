"""lodestore: a Spark-first engine for conversational memory stores."""
