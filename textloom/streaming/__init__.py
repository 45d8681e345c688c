"""Incremental runs: new files in a folder go through the same plans, once each."""
