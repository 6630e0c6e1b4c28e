"""plotmere: location-listing analytics and corpus preparation on Spark DataFrames."""
