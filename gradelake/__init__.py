"""gradelake: deterministic evaluation datasets and verifiable grading on Spark DataFrames."""
