"""Training-data operators: dedup, filtering, mixing, packing and token output.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; :mod:`graphloom.llm.queries` registers the
``opN_*`` queries that apply them to whole tables.
"""
