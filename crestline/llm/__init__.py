"""Training-data operators: dedup, filters, mixing, sharding, packing, scoring.

Nothing outside this subpackage imports it.  Every operator is a function
``DataFrame -> DataFrame``; heavy state (classifier weights, language-model weights,
count tables) lives in DataFrames or in objects whose size is bounded by a documented
parameter.
"""
