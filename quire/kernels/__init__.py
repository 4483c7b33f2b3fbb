"""Byte kernels: plain Python without Spark, run in batches by the sources. Nothing here raises on damaged input but DocumentError at open."""
