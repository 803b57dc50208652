"""A PySpark-native engine for grounded question answering over a curated text corpus.

The core turns captured pages into chunks, indexes them as DataFrames, ranks and gates passages for
batches of questions and checks the quality of the tables on the way. The optional subpackage ``llm``
holds operators for preparing training data; nothing outside it imports it.
"""

__version__ = "0.1.0"
