"""Equality maps over JSON parameters, as one predicate."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParameter


def matches(conditions: dict, parameters: str | Column = "parameters") -> Column:
    """Conjunction of equalities on top-level keys of a JSON text; a missing key does not match.

    A null condition asks for a JSON null; numbers compare as doubles; arrays and objects as compact JSON.
    """
    doc = F.col(parameters) if isinstance(parameters, str) else parameters
    out = F.lit(True)
    for key, want in conditions.items():
        if not isinstance(key, str):
            raise InvalidParameter(repr(key))
        raw = F.try_variant_get(F.try_parse_json(doc), F.lit("$[" + json.dumps(key) + "]"), "variant")
        if want is None:
            test = F.is_variant_null(raw)
        elif isinstance(want, bool):
            test = (F.schema_of_variant(raw) == "BOOLEAN") & (raw.cast("boolean") == want)
        elif isinstance(want, (int, float)):
            test = F.schema_of_variant(raw).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)") & (F.try_variant_get(raw, F.lit("$"), "double") == float(want))
        elif isinstance(want, str):
            test = (F.schema_of_variant(raw) == "STRING") & (F.try_variant_get(raw, F.lit("$"), "string") == want)
        else:
            test = F.to_json(raw) == json.dumps(want, separators=(",", ":"))
        out = out & F.coalesce(test, F.lit(False))
    return out
