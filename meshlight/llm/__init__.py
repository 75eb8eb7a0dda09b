"""Operators for building training corpora: de-duplication, filtering, extraction, mixing.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; ``queries`` binds them to the fixture tables.
"""
