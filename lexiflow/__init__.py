"""lexiflow: Spark-native operators for labelled text and tabular records.

Every operator is a function ``DataFrame -> DataFrame`` (or ``Column -> Column``
for text expressions) built from Spark SQL expressions, joins, aggregations and
windows, so Catalyst plans it and whole-stage codegen runs it.
"""

__version__ = "0.1.0"
