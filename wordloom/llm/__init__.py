"""Operators for building training corpora: filtering, deduplication,
decontamination, token counting, token files, packing, tokenizer alignment,
license scans and vector codes.

Nothing outside this subpackage imports it.
"""
