"""Settings of lexical preparation; they travel with prepared tables as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Preparation:
    """How tokens become active forms.

    ``expressions`` maps phrases of words (joined by a space) to their
    replacement, those of the lexicon (``lexicon_expressions``) in a second pass;
    ``synonyms`` maps variants to canonical lemmas.
    """

    stopwords: tuple[str, ...] = ()
    synonyms: dict[str, str] = field(default_factory=dict)
    expressions: dict[str, str] = field(default_factory=dict)
    lexicon_expressions: dict[str, str] = field(default_factory=dict)
    adverbs_active: bool = True
    unknown_active: bool = True
    min_token_length: int = 1
    anonymous_prefix: str | None = None
    segment_tokens: int = 40
    min_occurrences: int = 3

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Preparation:
        values = json.loads(text)
        values["stopwords"] = tuple(values["stopwords"])
        return cls(**values)
