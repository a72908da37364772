"""Lexical analytics on Spark; the names that most callers need."""

from lexmill.config import Preparation
from lexmill.errors import CorpusError, LexicalError, MatrixError
from lexmill.functions.text import sentences, strip_accents, tokens
from lexmill.operators.dtm import dtm
from lexmill.operators.lexicon import keyed_lexicon
from lexmill.operators.segment import active_forms, segments
from lexmill.sinks.export import starred_text, wide_dtm
from lexmill.sources.documents import import_directory

__version__ = "0.2.0"
__all__ = [
    "CorpusError", "LexicalError", "MatrixError", "Preparation", "active_forms", "dtm", "import_directory",
    "keyed_lexicon", "segments", "sentences", "starred_text", "strip_accents", "tokens", "wide_dtm",
]
