"""Training-data operators: secrets, packing, tokens, HTML, top-k, quality, near-duplicates, language models.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin contract queries.
"""
