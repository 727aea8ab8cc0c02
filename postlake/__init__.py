"""postlake: a job-posting lake on Spark.

Landed crawl responses go in; a clean, deduplicated postings table comes out,
together with filtered listings, ranked full-text search, per-company
statistics and processing metrics. Everything is a DataFrame job.
"""
