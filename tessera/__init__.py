"""Evidence-typed urban analytics on Spark: DataFrame operators over many cities at once."""
