"""Column expressions (all JVM built-ins, no Python UDFs)."""

from fathom.functions.text import contains_ci, gap_to_null, is_strict_number, search_any, strip_ws, to_number
from fathom.functions.dates import (fmt_dataset_date, fmt_model_date, fmt_run_date,
                                    parse_dataset_date, parse_model_date, parse_run_date,
                                    relative_age)
from fathom.functions.nested import extra, first_or_blank, lenient_json_list

__all__ = [n for n in dir() if not n.startswith("_")]
