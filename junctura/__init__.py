"""Junction calling between two genomes as PySpark DataFrame stages."""
