"""Spark-native analytics over a site crawl joined with its search-performance facts."""
