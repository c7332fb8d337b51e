"""PySpark-native analytics for sequencing evidence, records and text."""
