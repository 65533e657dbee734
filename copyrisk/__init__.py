"""Copy-risk analytics on Spark: flag claims in text, resolve, roll up, evaluate and compare."""
