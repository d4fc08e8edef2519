"""Sentiment analytics over short texts, written as Spark DataFrame jobs."""
