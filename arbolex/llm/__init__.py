"""Training-data operators: packing, licence and secret scans, token output, decontamination,
near-duplicate and line dedup, quality rules, token counts and chat formatting.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
