"""Subject-aware signal classification studies as Spark DataFrame plans."""
