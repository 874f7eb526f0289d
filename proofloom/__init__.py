"""proofloom: evidence retrieval, ranking and evaluation as Spark DataFrame plans."""
