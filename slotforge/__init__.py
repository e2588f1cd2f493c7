"""slotforge: market analytics tables on Spark, batch and streaming."""
