"""Data skipping for block-structured particle tables, expressed as Spark DataFrame plans."""
