"""Training-data pipeline operators: thirteen operators over documents, pages and embeddings.

Nothing else in the library imports this subpackage; `queries` holds the thin
`opN_<name>` queries and their SQL.
"""
