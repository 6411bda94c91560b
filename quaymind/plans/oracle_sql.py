"""DuckDB oracle building blocks.

Brute-force SQL re-statements of the operators, used only to check the
Spark jobs (the driver runs them next to ``queries()``).  Each helper
returns a SQL expression or CTE body in DuckDB syntax.
"""

from __future__ import annotations

from quaymind.sources.fixtures import with_views

NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
WS = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
      r"\x{202f}\x{205f}\x{3000}]")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def blank(x: str) -> str:
    """str(v or '').strip()"""
    return f"coalesce({strip(x)}, '')"


def parse_price(x: str) -> str:
    raw = f"replace({strip(f'CAST({x} AS VARCHAR)')}, ',', '')"
    raw = strip(f"replace(replace({raw}, 'RM', ''), 'rm', '')")
    return f"(CASE WHEN regexp_matches({raw}, '{NUMBER_RE}') THEN TRY_CAST({raw} AS DOUBLE) END)"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: length(t) > 1)"


def ordered_unique(lst: str) -> str:
    """list distinct keeping first-seen order (DuckDB's list_distinct does not)."""
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def storage_gb(x: str) -> str:
    t = f"lower({blank(x)})"
    q = f"regexp_extract({t}, '(\\d+)\\s*(tb|gb)?', 1)"
    u = f"regexp_extract({t}, '(\\d+)\\s*(tb|gb)?', 2)"
    return (f"(CASE WHEN {q} = '' THEN 1000000000 WHEN {u} = 'tb' THEN CAST({q} AS BIGINT) * 1024 "
            f"ELSE CAST({q} AS BIGINT) END)")


def sql(views: list[str], ctes: list[tuple[str, str]], body: str) -> str:
    extra = ",\n".join(f"{n} AS ({b})" for n, b in ctes)
    if not extra:
        return with_views(views, body)
    base = with_views(views, "")
    if base.strip():
        return base.rstrip() + ",\n" + extra + "\n" + body
    return "WITH " + extra + "\n" + body
