"""docquarry: a PySpark-native engine for document-derived data.

Sub-packages: ``functions`` (Column functions and Arrow UDFs), ``operators``
(DataFrame -> DataFrame), ``sources`` (readers and sinks), ``streaming``
(Structured Streaming jobs), ``plans`` (registered queries and their SQL) and
``llm`` (training-data operators, optional: nothing else imports it).
"""
