"""Operations of a training-data pipeline, one module per operator.

Nothing outside this folder imports it; ``queries.py`` lists the registered
queries and their SQL.
"""
