"""Training-data operators: ten corpus-scale building blocks over the ``documents`` family of tables.

Nothing outside this subpackage imports it. Each module has one operator with a general interface; ``queries`` binds
them to the registered ``opN_<name>`` queries.
"""
