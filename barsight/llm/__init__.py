"""Training-data operators: dedup, decontamination, scoring, tokenizing and web-archive derivation on Spark."""
