"""Translations between the pipeline language's dialects and Spark expressions."""
