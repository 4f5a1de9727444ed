"""Labels and names as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short names of known judges. Two names may share one short name.
KNOWN_SLUGS = {
    "deepseek/deepseek-v3.2": "deepseek",
    "google/gemini-3-flash-preview": "gemini",
    "x-ai/grok-4.20-beta": "grok",
    "anthropic/claude-sonnet-4.6": "claude",
    "anthropic/claude-sonnet 4.6": "claude",
    "openai/gpt-5.4": "gpt54",
    "openai/gpt-5.4-pro": "gpt54",
}

_SLUG_FROM, _SLUG_TO = "/:-. ", "_____"


def gold_winner(choice: Column) -> Column:
    """A for ``text1``; B for everything else, null and typos included."""
    return F.when(choice == "text1", "A").otherwise("B")


def opposite(label: Column) -> Column:
    """The other side. Whatever is not B (null included) maps to B."""
    return F.when(label == "B", "A").otherwise("B")


def verdict(winner: Column) -> Column:
    """A or B, null for any other value."""
    return F.when(winner.isin("A", "B"), winner)


def swap_consistent(main: Column, swapped: Column) -> Column:
    """1 when the displayed label flips with the order, 0 when not, null if a verdict is missing."""
    return (verdict(main) != verdict(swapped)).cast("int")


def prompt_consistent(first: Column, second: Column) -> Column:
    """1 when both prompts give the same label; a missing verdict counts as 0."""
    return F.coalesce(first == second, F.lit(False)).cast("int")


def safe_name(model: Column) -> Column:
    """Judge name usable as a file or folder name."""
    return F.translate(model, "/:\\", "___")


def judge_slug(model: Column) -> Column:
    """Short column prefix for a judge: known names first, then a cleaned lower-case name."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN_SLUGS.items() for x in pair])
    return F.coalesce(
        F.try_element_at(known, model), F.translate(F.lower(model), _SLUG_FROM, _SLUG_TO)
    )


def judge_slug_of(model: str) -> str:
    """``judge_slug`` for one name known on the driver (column names of a wide table)."""
    cleaned = model.lower().translate(str.maketrans(_SLUG_FROM, _SLUG_TO))
    return KNOWN_SLUGS.get(model, cleaned)
