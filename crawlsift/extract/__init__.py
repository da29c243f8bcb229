"""Extraction jobs: a table of captured pages in, fact tables out."""
