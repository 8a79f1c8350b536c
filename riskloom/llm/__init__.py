"""Training-data operators (secrets, near duplicates, toxicity, language, quality, decontamination, WARC, packing).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers its queries only when it is present.
"""
