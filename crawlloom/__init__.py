"""crawlloom: web-crawl analytics and corpus preparation on Spark DataFrames."""
