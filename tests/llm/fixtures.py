"""Small tables with every awkward case, and brute-force helpers."""

from __future__ import annotations

import random
import re

WORDS = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "")]


def sentence(rng: random.Random, n: int = 12) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def prose(rng: random.Random, sentences: int = 10) -> str:
    return " ".join(sentence(rng, rng.randint(6, 16)) for _ in range(sentences))


def corpus(seed: int = 1, n: int = 30) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): prose, copies, near copies, nulls, empty and very long texts."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(4, 12)) for _ in range(n)]
    texts += [texts[0], texts[0], texts[1] + " Tail.", texts[2].replace(".", ",", 1), None, "", "   ", "...", None, prose(rng, 2500), "x" * 200_000]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[4], "en", "s1", None), (None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return re.findall(r"(?:[a-z0-9_]|[^\x00-\x7f])+", (text or "").lower())


def shingles(text: str | None, n: int = 3) -> set:
    ws = words(text)
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def similarity(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0
