"""Training-data operators: token counts, packing, near-duplicates, repeated passages, URL and
quality filters, license rules, exact top-k search, source mixing and page text extraction.

Each module holds one operator with its general interface; ``queries`` registers the thin
``opN_<name>`` queries.  Nothing outside this package imports it.
"""
