"""Operators for preparing large text corpora for model training.

Each module holds one operator with its own interface; ``queries`` binds
them to the shared tables and gives SQL where SQL can express the result.
Nothing outside this subpackage imports it.
"""
