"""Meeting transcripts and training-data preparation on Spark DataFrames."""
