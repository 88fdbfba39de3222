"""Operators for text corpora: quality rules, secrets, packing, language, URLs, token files,
decontamination, duplicate spans, near-duplicates and page text.

``catalog`` registers one query per operator. Nothing outside this folder imports it, save the
guarded import of ``__spark_entry__`` and ``corpus_pipeline``.
"""
