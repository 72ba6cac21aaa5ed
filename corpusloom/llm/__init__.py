"""Training-data operators: tokenising, deduplication, filtering, scoring and packing.

Nothing outside this subpackage imports it; the queries it offers are listed
in :mod:`corpusloom.llm.queries`.
"""
