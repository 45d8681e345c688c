"""Whole pipelines: scrape, annotate, flatten, train text. Each is a plan of functions and operators."""
