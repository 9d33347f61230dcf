"""Training-data operators: archives, deduplication, tokens, language, quality, privacy and licences.

Nothing outside this subpackage imports it; `__spark_entry__.py` adds its queries when it is present.
"""
