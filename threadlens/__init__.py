"""Analytics over conversation transcripts, as PySpark DataFrame programs."""
