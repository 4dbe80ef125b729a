"""Streams.

The work has no stateful streaming operators.  Column generation and nulls
missing completely at random are stateless expressions of the row key, so
``generate_columns`` and ``inject_nulls`` (MCAR patterns) accept a streaming
DataFrame as they are; see ``tests/test_streaming.py``.
"""
