"""Array / map / JSON helpers used by the catalogue projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extra(extras: Column | str, key: str) -> Column:
    """Value of ``key`` in a key/value array, last duplicate wins, ``""`` when absent.

    Works without ``spark.sql.mapKeyDedupPolicy``: the array is reversed and
    the first match taken.
    """
    arr = F.col(extras) if isinstance(extras, str) else extras
    hit = F.get(F.filter(F.reverse(arr), lambda e: e["key"] == F.lit(key)), 0)
    return F.coalesce(hit["value"], F.lit(""))


def with_extras(df, keys: list[str], extras: str = "extras", prefix: str = "_x_"):
    """Each listed extra looked up once per row into ``<prefix><key>``.

    Every ``extra()`` call builds its own lambda, so repeated lookups of one
    key are distinct expressions to Catalyst and are each evaluated. Reading
    them from columns of a first projection evaluates each once; the
    optimizer keeps that projection because the lookups are not cheap."""
    return df.select("*", *[extra(extras, k).alias(prefix + k) for k in keys])


def first_or_blank(arr: Column, field: str) -> Column:
    """``field`` of the first element, ``""`` for an empty array."""
    return F.coalesce(F.get(arr, 0)[field], F.lit(""))


def lenient_json_list(raw: Column) -> Column:
    """JSON array of strings; blank, malformed or non-array text gives ``[]``."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def dedup_last_value(params: Column) -> Column:
    """{name, value} list -> entries keyed by name, in first-seen order with the
    last value (what building a dict from the list gives)."""
    idx = F.transform(params, lambda e, i: F.struct(e["name"].alias("name"), e["value"].alias("value"),
                                                    i.alias("i")))
    firsts = F.filter(idx, lambda e: ~F.exists(idx, lambda o: (o["name"] == e["name"]) & (o["i"] < e["i"])))
    return F.transform(firsts, lambda e: F.struct(
        e["name"].alias("key"),
        F.get(F.filter(F.reverse(idx), lambda o: o["name"] == e["name"]), 0)["value"].alias("value")))


def params_to_config_json(params: Column) -> Column:
    """M4: model parameters as a JSON object text, ``{}`` when there are none."""
    ent = dedup_last_value(params)
    return (F.when(params.isNull() | (F.size(params) == 0), F.lit("{}"))
            .otherwise(F.to_json(F.map_from_entries(ent))))
