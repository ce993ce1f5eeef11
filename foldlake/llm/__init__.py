"""Training-data operators over document tables.

Nothing outside this subpackage imports it.  Every module holds one operator with a general
interface; ``queries`` derives the digest columns of the registered queries from them.
"""
