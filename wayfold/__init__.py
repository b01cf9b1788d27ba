"""wayfold: place resolution, gazetteer building and text-clue analytics on Spark DataFrames."""
