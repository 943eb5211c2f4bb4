"""Evidence analytics for webshop investigations, on Spark DataFrames."""
