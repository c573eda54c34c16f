"""Training-data operators on ``documents`` and ``embeddings`` tables.

Each module holds one operator with a general interface; ``queries`` derives the
``opN_*`` contract tables from them.
"""
