"""Operators for large-scale training-data pipelines.

Self-contained: nothing else in the library imports this subpackage.  Every
operator takes a DataFrame shaped like ``documents`` (at least ``doc_id`` and
``text``), ignores columns it does not need, and keeps all state that outlives
a task in DataFrames, in tables below the shared checkpoint folder, or in
broadcasts whose size is fixed by a documented parameter.
"""
