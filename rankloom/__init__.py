"""rankloom: a PySpark-native search, ranking and record-cleaning engine.

Subpackages
-----------
sources     readers, writers, caches
functions   Column -> Column building blocks (text, features, job descriptions, explanations)
operators   DataFrame -> DataFrame operators (records, retrieval, metrics, intervals, ...)
plans       query catalogue run by the driver, with the SQL each query is checked against
streaming   Structured Streaming variants
llm         operators for language-model training data (optional; nothing else imports it)
"""

__version__ = "0.1.0"
