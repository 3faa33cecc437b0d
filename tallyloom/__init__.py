"""tallyloom: matching and classification of records across feeds, as Spark DataFrames."""
