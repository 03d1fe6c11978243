"""The bindings of ``fathom.sources.bindings`` as SQL CTEs for the DuckDB oracle.

Built from the same SQL texts the Spark side evaluates, so both engines read
one definition of the test catalogue.
"""

from __future__ import annotations

from fathom.sources.bindings import EXTRA_ARMS, PKG_COLUMNS, RESOURCE_COLUMNS, RESOURCE_ORDER

EXTRA_KEYS = sorted({k for _, k, _, _ in EXTRA_ARMS})


def _pkg() -> str:
    cols = ",\n  ".join(f"{sql} AS {name}" for name, sql in PKG_COLUMNS.items())
    return f"SELECT o_orderkey AS pkg_id,\n  {cols}\nFROM orders LEFT JOIN part ON p_partkey = o_custkey"


def _extras() -> str:
    arms = []
    for pos, key, value_sql, where_sql in EXTRA_ARMS:
        w = f" WHERE {where_sql}" if where_sql else ""
        arms.append(f"SELECT o_orderkey AS pkg_id, {pos} AS pos, '{key}' AS k, {value_sql} AS v FROM orders{w}")
    return "\nUNION ALL ".join(arms)


def _resources() -> str:
    cols = ",\n  ".join(f"{sql} AS {name}" for name, sql in RESOURCE_COLUMNS.items())
    order = ", ".join(RESOURCE_ORDER)
    return (f"SELECT l_orderkey AS pkg_id,\n  ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {order}) - 1 AS pos,\n"
            f"  {cols}\nFROM lineitem")


def _pivot() -> str:
    # one row per package, one column x_<key> per extra key, last duplicate wins, '' when absent
    sel = ",\n  ".join(f"coalesce(arg_max(v, pos) FILTER (WHERE k = '{k}'), '') AS x_{k}" for k in EXTRA_KEYS)
    return (f"SELECT p.pkg_id,\n  {sel}\nFROM pkg p LEFT JOIN pkg_extras e ON e.pkg_id = p.pkg_id GROUP BY p.pkg_id")


def with_catalogue(body: str) -> str:
    """Prefix ``body`` with the catalogue CTEs: pkg, pkg_extras, pkg_resources, px
    (pkg joined to its pivoted extras)."""
    body = body.lstrip("\n")
    if body.startswith(","):
        body = ",\n" + body[1:].lstrip()
    return (f"WITH pkg AS (\n{_pkg()}\n),\npkg_extras AS (\n{_extras()}\n),\n"
            f"pkg_resources AS (\n{_resources()}\n),\nxp AS (\n{_pivot()}\n),\n"
            f"px AS (SELECT pkg.*, xp.* EXCLUDE (pkg_id) FROM pkg JOIN xp USING (pkg_id))\n{body}")
