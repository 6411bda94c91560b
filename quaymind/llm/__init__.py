"""Training-data operators: sharding, chat formatting, HTML extraction, PII,
near-duplicates, quality rules, tokenizing, mixing, secrets and top-k search.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only when it can be imported.
"""
