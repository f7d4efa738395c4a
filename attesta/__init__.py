"""Evidence, stance and credibility analytics over Spark DataFrames."""
