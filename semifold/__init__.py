"""semifold: factors, datasets, graphs and inference as Spark DataFrame plans."""
