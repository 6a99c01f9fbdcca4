"""Operators of a training-data pipeline.

Each module is one operator (see ``queries`` for the registered names); all of
them run as Spark jobs over whole tables. Nothing else in the library imports
this subpackage.
"""
