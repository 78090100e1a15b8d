"""furrow: dataset curation and classifier evaluation on Spark DataFrames."""
