"""Words, whitespace and keyword tests.

The functions of this package build Spark SQL expression text from expression text; callers wrap the
result in ``F.expr``.  Long expressions are planned as one string instead of thousands of Column calls.
"""

from __future__ import annotations

# A word is a run of characters outside Unicode white space; the four
# separators U+001C..U+001F count as white space too.
WORD = r"(?U)[^\s\x1c-\x1f]+"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANK_LINE = r"(?U)^[\s\x1c-\x1f]*$"

# Words whose presence excludes a message or a content part.
EXCLUDED_KEYWORDS = ("system", "search", "web", "result", "source", "thinking", "thought")

# Punctuation stripped from the words of a slug.
SLUG_EDGES = r"\A[.,!?]+|[.,!?]+\z"


def raw(text: str) -> str:
    """SQL literal whose backslashes are kept."""
    return f"r'{text}'"


def let(value: str, name: str, body: str) -> str:
    """Bind a value to a name inside an expression, so that it is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, {raw(WORD)}, 0)"


def word_count(text: str) -> str:
    return f"size({words(text)})"


def strip(text: str) -> str:
    """White space off both ends; looks at the ends only, however long the text."""
    escaped = "".join(f"\\u{ord(c):04x}" for c in SPACES)
    return f"btrim({text}, '{escaped}')"


def has_excluded_keyword(text: str) -> str:
    """True when any excluded keyword occurs inside the text, in any case; never null."""
    return f"coalesce(lower({text}) rlike '{'|'.join(EXCLUDED_KEYWORDS)}', false)"


def first_words(text: str, n: int) -> str:
    return f"array_join(slice({words(text)}, 1, {n}), ' ')"


def fallback_label(title: str, cluster_id: str) -> str:
    """First three words of a title, or ``Cluster N`` when it has none."""
    return f"coalesce(nullif({first_words(title, 3)}, ''), concat('Cluster ', cast({cluster_id} as string)))"


def fallback_slug(title: str, cluster_id: str) -> str:
    """Kebab-case form of the fallback label, or ``cluster-N`` when nothing is left."""
    trimmed = f"transform(slice({words(title)}, 1, 3), w -> lower(regexp_replace(w, {raw(SLUG_EDGES)}, '')))"
    slug = f"array_join(filter({trimmed}, w -> w != ''), '-')"
    return f"coalesce(nullif({slug}, ''), concat('cluster-', cast({cluster_id} as string)))"


def embedding_text(title: str, excerpt: str) -> str:
    """Text sent to the embedding model: title, blank line, excerpt."""
    return f"concat_ws('\\n\\n', {title}, nullif({excerpt}, ''))"
