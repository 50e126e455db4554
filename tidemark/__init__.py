"""Medallion analytics on Spark: cleaning, history, facts, marts, monitoring, incidents."""
