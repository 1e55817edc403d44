"""SQL fragments that the queries' DuckDB forms share."""

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def lower(column: str) -> str:
    return LOWER.format(column)


def spaced(column: str) -> str:
    """Words between white space."""
    return f"regexp_extract_all({column}, '[^\\x20\\x09-\\x0D]+')"


def alnum(column: str) -> str:
    """Words of letters, digits and everything beyond ASCII, of a lower-cased column."""
    return f"regexp_extract_all({column}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
