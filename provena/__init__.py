"""A text-originality and corpus analytics engine on Spark DataFrames."""
