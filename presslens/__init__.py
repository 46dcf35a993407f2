"""presslens — Spark-native analytics for dated, attributed news text.

Every job takes and returns DataFrames; nothing is collected to the driver.
"""

__version__ = "0.1.0"
