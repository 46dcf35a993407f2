"""Small word tables of our own used as default inputs of the text jobs.

They are inputs, not constants of the engine: every job that uses one
also accepts a DataFrame in its place (the full lexicon, a gazetteer or a
valence lexicon the user brings).
"""

from __future__ import annotations

import json
import os

HERE = os.path.dirname(os.path.abspath(__file__))
TOPIC_LEXICON_PATH = os.path.join(HERE, "topic_lexicon.json")

# Our own place/nationality names for the geography tagger; the nation and
# region names of the driver tables are added to these at run time.
PLACE_NAMES = (
    "U.S.", "US", "USA", "America", "American", "Americas", "UK", "Britain", "British", "England",
    "Europe", "European", "Asia", "Asian", "Africa", "African", "China", "Chinese", "Japan",
    "Japanese", "India", "Indian", "Canada", "Canadian", "Mexico", "Mexican", "Russia",
    "Russian", "Germany", "German", "France", "French", "Australia", "Australian", "Brazil",
    "Middle", "East", "California", "Texas", "Florida", "London", "Paris", "Berlin", "Tokyo",
)

# Our own valence table over frequent words of the test corpus and a few
# English sentiment words: exercises the scoring mechanics only.
VALENCE = {
    "the": 0.5, "of": -0.4, "and": 1.2, "to": -1.1, "in": 0.3, "is": 0.8, "de": -0.7, "la": 0.9,
    "le": -0.2, "der": 1.5, "die": -1.6, "et": 0.6, "en": -0.5, "el": 0.4, "y": -0.3,
    "good": 1.9, "great": 3.1, "happy": 2.7, "love": 3.2, "win": 2.8, "bad": -2.5,
    "terrible": -2.9, "sad": -2.1, "hate": -2.7, "loss": -1.3, "crisis": -3.1, "war": -2.9,
}
NEGATORS = ("not", "no", "never", "nor", "without")


def topic_lexicon_json(path: str = TOPIC_LEXICON_PATH) -> str:
    with open(path, encoding="utf-8") as fh:
        return fh.read()


def lexicon_rows(text: str) -> list[tuple[str, int, str, int]]:
    """(topic, topic_pos, keyword, keyword_pos) in file order of the JSON text."""
    obj = json.loads(text)  # dict keeps key order of the text
    return [(t, i, k, j) for i, (t, kws) in enumerate(obj.items()) for j, k in enumerate(kws)]
