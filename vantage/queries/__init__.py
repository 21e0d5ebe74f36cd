"""Queries over the test tables, each with its twin in DuckDB SQL where SQL can express it.

"""
