"""Checks on query arguments, made before a plan is built."""

from __future__ import annotations

from datetime import datetime, timezone


def within(name: str, value: int, low: int, high: int | None = None) -> int:
    if value < low or (high is not None and value > high):
        bound = f"at least {low}" if high is None else f"between {low} and {high}"
        raise ValueError(f"{name} must be {bound}, got {value}")
    return value


def utc(moment: datetime | None = None) -> datetime:
    """An aware UTC instant: the given one, or now. A naive one is taken as UTC."""
    if moment is None:
        return datetime.now(timezone.utc)
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)
