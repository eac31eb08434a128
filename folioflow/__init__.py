"""folioflow: batch work over large document collections, as Spark DataFrames.

Operators take DataFrames and return DataFrames. None of them makes a session,
reads a clock or picks a path: those are arguments.
"""
