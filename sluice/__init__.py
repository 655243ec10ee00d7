"""sluice: a pipe-query analytics engine that builds Spark DataFrame plans."""
