"""Literature analytics on Spark DataFrames: reconcile, split, vectorise, rank, evaluate."""
