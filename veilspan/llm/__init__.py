"""Training-data operators: chat formatting, token counts, URL filters, token files, toxicity,
near-duplicate joins, language-model scores, packing, quality rules and decontamination.

Nothing outside this subpackage imports it.
"""
