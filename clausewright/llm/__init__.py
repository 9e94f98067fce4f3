"""Training-data operators: thirteen Spark jobs over whole corpora, and their queries.

Nothing outside this subpackage imports it; the repository works without it.
"""
