"""Settings of the retrieval engine. The values are fixed by the behaviour that is reproduced."""

from __future__ import annotations

from dataclasses import dataclass

# Keyword and what a question that contains it is extended by, in this order.
EXPANSIONS = (
    ("revenue", "total net sales net sales"),
    ("sales", "net sales total net sales"),
    ("income", "net sales revenue earnings"),
    ("cash", "cash equivalents marketable securities liquidity"),
    ("debt", "long-term debt borrowings"),
    ("r&d", "research and development expense"),
    ("rd", "research and development expense"),
    ("risk", "risk factors ITEM 1A"),
    ("margin", "gross margin profitability"),
)

# Where texts are split, from the coarsest separator to single characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 400
    chunk_overlap: int = 50
    separators: tuple[str, ...] = SEPARATORS
    expansions: tuple[tuple[str, str], ...] = EXPANSIONS
    top_k: int = 5
    snippet: int = 200
    title: int = 40
    question_max: int = 500
    embed_batch: int = 100
    collection: str = "documents"
    mode: str = "dummy"


DEFAULT = Settings()


def normalised_mode(mode: str | None) -> str:
    """``rag`` or ``dummy``, in any case and with blanks around; anything else is ``dummy``."""
    mode = (mode or "").strip().lower()
    return mode if mode in ("rag", "dummy") else "dummy"
