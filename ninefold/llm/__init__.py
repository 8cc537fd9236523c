"""Operations of a training-data pipeline over tables of documents and vectors.

Every operator takes and returns DataFrames. Operators that look at one document at a time take
the names of the key and text columns, ignore all other columns and return the key with their own
columns, so a clashing name in the input cannot disturb them.
"""
