"""glossaflow: document localisation analytics expressed as Spark DataFrames."""
