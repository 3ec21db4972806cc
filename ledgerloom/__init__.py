"""Ledgerloom: payee resolution and training-data preparation as PySpark operators.

Every operator takes DataFrames and returns a DataFrame.  ``ledgerloom.llm`` holds the operators for language-model
data; nothing outside that subpackage imports it.
"""
