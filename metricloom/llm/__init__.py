"""Operations of a training-data pipeline over documents, pages and conversations.

Nothing else in the library imports this package; ``workload.py`` holds its registered queries
and their comparison SQL.
"""
