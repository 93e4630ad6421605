"""Sondera: a Spark-native engine for building, maintaining and querying text corpora.

Every operator takes DataFrames and returns DataFrames; nothing is executed
until the caller asks for rows.
"""

__version__ = "0.1.0"
