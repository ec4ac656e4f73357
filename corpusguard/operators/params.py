"""Parameters of a findings query, checked before anything runs."""

from __future__ import annotations


def listed(text: str | None) -> list[str]:
    """Values between commas; empty ones go, and no text is no value."""
    return [v for v in (text or "").split(",") if v]


def positive(text: str | int, name: str = "value") -> int:
    """A positive whole number, written plainly."""
    if isinstance(text, bool) or not str(text).isascii() or not str(text).isdigit() or int(text) < 1:
        raise ValueError(f"{name} must be a positive whole number")
    return int(text)


def members(values: list[str], domain: tuple[str, ...] | list[str], name: str = "value") -> list[str]:
    if unknown := [v for v in values if v not in domain]:
        raise ValueError(f"unknown {name}: {unknown}")
    return values


def allowed(selected: list[int], within: list[int]) -> list[int]:
    """The selection, if all of it may be seen; asking for more is an error, and an
    empty selection is everything that may be seen."""
    if set(selected) - set(within):
        raise ValueError("the selection goes beyond what may be seen")
    return selected or list(within)
