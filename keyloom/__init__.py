"""keyloom: ordered, keyed and versioned data as Spark DataFrames."""
