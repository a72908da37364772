"""Small dictionaries of the registered queries, for the invented languages of the test tables.

They stand for the lexicon, synonyms and word lists that a user brings; the
queries take them as DataFrames and the SQL has them as VALUES.
"""

from __future__ import annotations

from lexmill.config import Preparation

LEXICON: tuple[tuple[str, str, str], ...] = (
    ("the", "the", "art"), ("a", "a", "art"), ("an", "a", "art"), ("la", "la", "art"), ("le", "le", "art"), ("les", "le", "art"),
    ("des", "de", "art_def"), ("un", "un", "art"), ("el", "el", "art"), ("der", "der", "art"), ("die", "der", "art"), ("den", "der", "art"),
    ("of", "of", "pre"), ("to", "to", "pre"), ("in", "in", "pre"), ("for", "for", "pre"), ("on", "on", "pre"), ("with", "with", "pre"),
    ("by", "by", "pre"), ("at", "at", "pre"), ("from", "from", "pre"), ("de", "de", "pre"), ("en", "en", "pre"), ("von", "von", "pre"),
    ("and", "and", "con"), ("as", "as", "conj"), ("que", "que", "conj"), ("et", "et", "con"), ("und", "und", "con"),
    ("is", "be", "aux"), ("was", "be", "aux"), ("are", "be", "aux"), ("be", "be", "aux"),
    ("that", "that", "pro"), ("it", "it", "pro_per"), ("this", "this", "pro"), ("he", "he", "pro_per"), ("es", "es", "pro"),
    ("ononst", "ononst", "ver"), ("inoran", "inor", "adj"), ("orantion", "inor", "nom"), ("tion", "tion", "nom_sup"), ("ly", "ly", "adv"), ("ing", "ing", "num"), ("ed", "ed", "num_ord"),
)

#: A chain of two, one of eighty, and a cycle with a way into it.
SYNONYMS = {"orre": "rewh", "thatin": "hehely", "hehely": "rewh"} | {f"link{i:02}": f"link{i + 1:02}" for i in range(80)} | {"way": "ring1", "ring1": "ring2", "ring2": "ring1"}

PREP = Preparation(stopwords=("nd", "th"), synonyms=SYNONYMS, adverbs_active=False, min_token_length=2)

EXPRESSIONS = {"of the": "of_the", "in the": "in_the", "de la": "de_la", "it was that": "it_was_that"}

#: The lexicon's own, for what the user's leave; one begins with a replacement of theirs.
LEXICON_EXPRESSIONS = {"of_the in": "of_the_in", "the the": "the_twice", "de de la": "never", "to be": "to_be"}

POLARITY: tuple[tuple[str, int], ...] = (("rewh", 1), ("ononst", 1), ("ing", 1), ("ea", 1), ("inor", -1), ("nt", -1), ("ou", -1), ("st", -1))

NEGATIONS = ("ti", "er", "ha")

EMOTIONS: tuple[tuple[str, str], ...] = (
    ("rewh", "joy"), ("orre", "joy"), ("orre", "trust"), ("thatin", "trust"), ("ononst", "fear"), ("ou", "fear"), ("inoran", "sadness"), ("ed", "sadness"),
    ("hehely", "anger"),
)
CATEGORIES = ["joy", "trust", "fear", "sadness", "anger"]

SEEDS = {"first": {"rewh", "ononst"}, "second": {"inor", "notthere"}}

#: (k, griffiths, cao_juan, arun, deveaud) of a tuning run.
TUNING: tuple[tuple[int, float, float, float, float], ...] = (
    (2, -9100.0, 0.41, 5.2, 1.1), (3, -8900.0, 0.30, 4.1, 1.4), (4, -8750.0, 0.24, 3.9, 1.5), (5, -8700.0, 0.27, 3.5, 1.3), (6, -8720.0, 0.33, 3.4, 1.2),
)
