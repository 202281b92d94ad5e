"""Operators for training-data pipelines: decontamination, packing, fingerprints,
sharding, privacy, secrets, token counts, scoring, near-duplicates and toxicity.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
