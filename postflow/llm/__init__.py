"""Operators of a training-data pipeline over a table of documents.

Rules that hold for every operator here, unless its docstring says otherwise: a null text counts as
an empty one; a null id is a valid id of its own and stays null in the result; every row is judged
by its own text, also where rows repeat an id; other columns are ignored, whatever their names; an
empty table gives an empty result.
"""
