"""What the library raises."""


class LexicalError(Exception):
    """Base of the library's errors."""


class CorpusError(LexicalError):
    """A corpus can't be read or is empty."""


class LexiconError(LexicalError):
    """A dictionary can't be read or is empty."""


class MatrixError(LexicalError):
    """A term table can't be built or is too small for an analysis."""
