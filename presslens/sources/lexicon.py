"""Topic lexicon source, JSON ``{topic: [keywords]}`` -> rows.

Positions come from the order in the text: the JSON object is parsed into
a map (insertion order = text order) and exploded with positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..resources import TOPIC_LEXICON_PATH, lexicon_rows, topic_lexicon_json

LEXICON_SCHEMA = "topic string, topic_pos int, keyword string, keyword_pos int"


def read_lexicon(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Lexicon file -> (topic, topic_pos, keyword, keyword_pos). ``path`` is
    read by Spark; without it the packaged lexicon is used, whose rows come
    from the driver's installation (executors need not have the file)."""
    if path is None:
        return spark.createDataFrame(lexicon_rows(topic_lexicon_json()), LEXICON_SCHEMA)
    raw = spark.read.text(path, wholetext=True)
    entries = raw.select(F.posexplode(F.map_entries(
        F.from_json("value", "map<string,array<string>>"))).alias("topic_pos", "e"))
    return entries.select(
        F.col("e.key").alias("topic"), F.col("topic_pos").cast("int"),
        F.posexplode("e.value").alias("keyword_pos", "keyword"),
    ).select("topic", "topic_pos", "keyword", F.col("keyword_pos").cast("int"))


def lexicon_values_sql(path: str = TOPIC_LEXICON_PATH) -> str:
    """The same rows as a SQL ``VALUES`` relation (for the DuckDB oracle)."""
    rows = lexicon_rows(topic_lexicon_json(path))

    def q(s):
        return "'" + s.replace("'", "''") + "'"
    vals = ", ".join(f"({q(t)}, {i}, {q(k)}, {j})" for t, i, k, j in rows)
    return f"(VALUES {vals}) AS lexicon(topic, topic_pos, keyword, keyword_pos)"
