"""weftline: credit-risk analytics expressed as Spark DataFrame plans."""
