"""File names for single conversations, as Spark SQL expression text."""

from __future__ import annotations

from foldwise.functions.text import raw, strip

# Characters kept in a file name, and those stripped from its ends.
NOT_KEPT = r"[^A-Za-z0-9._-]+"
NAME_EDGES = r"\A[-._]+|[-._]+\z"


def sanitize(value: str) -> str:
    """Letters, digits, dot, underscore and dash only; never empty."""
    token = f"regexp_replace(regexp_replace({value}, {raw(NOT_KEPT)}, '-'), {raw(NAME_EDGES)}, '')"
    return f"if({token} = '', 'conversation', {token})"


def numbered(index: str) -> str:
    return f"format_string('%04d', {index})"


def derive_identifier(conversation_id: str, id_: str, title: str, index: str) -> str:
    """First non-blank string of the three, sanitised; else a numbered default."""
    named = ", ".join(f"if({strip(c)} != '', {c}, null)" for c in (conversation_id, id_, title))
    return f"coalesce({sanitize(f'coalesce({named})')}, concat('conversation-', {numbered(index)}))"


def file_name(identifier: str, index: str) -> str:
    return f"concat({numbered(index)}, '-', {identifier}, '.json')"
