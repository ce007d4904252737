"""Factor formulas: expression trees over named fields, turned into Catalyst columns once, on the driver.

A tree gives a value and the reason why there is none; exactly one of the two is null. Leaves are {"field": name}
and {"const": text or number}; nodes have "op" with "left" and "right", "args" (and "weights", or "lower" and
"upper"), or "field" (and "n"). Relative ops look at all rows of the frame of the same security type, so the frame
must hold the population (a panel's date is in ``population`` too).
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINARY = ("add", "sub", "mul", "div", "ratio_pct")
RELATIVE = ("zscore", "percentile", "min_max_scale")
DEEPEST, SMALL_SAMPLE = 32, 30


@dataclass
class Formula:
    value: Column
    reason: Column
    inputs: tuple[str, ...]
    relative: tuple[str, ...] = ()


def NONE(kind: str) -> Column:  # noqa: N802
    return F.lit(None).cast(kind)


def defects(node, fields, depth: int = 0) -> list[str]:
    """What is wrong with a tree; nothing if it can be evaluated."""
    if depth > DEEPEST:
        return ["too_deep"]
    if not isinstance(node, dict):
        return ["not_a_node"]
    if "op" not in node:
        if set(node) == {"field"}:
            return [] if node["field"] in fields else [f"undeclared_field:{node['field']}"]
        if set(node) == {"const"}:
            return [] if number(node["const"]) is not None else ["bad_const"]
        return ["bad_leaf"]
    if "const" in node:
        return ["op_and_const"]
    op, shape = node["op"], set(node) - {"op"}
    expected = {"avg": {"args"}, "weighted_sum": {"args", "weights"}, "winsorize": {"args", "lower", "upper"}, "sum_last_n_quarters": {"field", "n"}}
    expected |= {b: {"left", "right"} for b in BINARY} | {r: {"field"} for r in RELATIVE}
    if op not in expected:
        return [f"unknown_op:{op}"]
    if shape != expected[op]:
        return [f"wrong_shape:{op}"]
    found = []
    if "field" in node and node["field"] not in fields:
        found.append(f"undeclared_field:{node['field']}")
    if op == "sum_last_n_quarters" and not (isinstance(node["n"], int) and node["n"] >= 1):
        found.append("bad_n")
    if op in ("weighted_sum", "winsorize") and not node["args"]:
        found.append(f"empty_args:{op}")
    if op == "weighted_sum" and len(node["args"]) != len(node["weights"]):
        found.append("weights_length")
    if op == "winsorize" and (number(node["lower"]) is None or number(node["upper"]) is None or number(node["lower"]) > number(node["upper"])):
        found.append("bad_bounds")
    for child in [node[k] for k in ("left", "right") if k in node] + list(node.get("args", [])):
        found += defects(child, fields, depth + 1)
    return found


def number(value) -> Decimal | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        out = Decimal(str(value))
    except InvalidOperation:
        return None
    return out if out.is_finite() else None


def literal(value) -> Column:
    return F.lit(float(number(value)))


def first_reason(parts: list[Formula]) -> Column:
    return F.coalesce(*(p.reason for p in parts)) if parts else F.lit("empty_args")


def compiled(node: dict, population: tuple[str, ...] = ("security_type",), relative: bool = True) -> Formula:
    """A tree as columns. ``relative``: False where no population is at hand; relative ops then say so."""
    if "field" in node and "op" not in node:
        v = F.col(node["field"]).cast("double")
        return Formula(v, F.when(v.isNull(), F.lit(f"missing_input:{node['field']}")), (node["field"],))
    if "const" in node:
        return Formula(literal(node["const"]), NONE("string"), ())
    op = node["op"]
    if op in RELATIVE:
        f = node["field"]
        v = F.col(f).cast("double")
        w = Window.partitionBy(*population)
        if op == "zscore":
            sd = F.stddev_pop(v).over(w)
            out = F.when(F.count(v).over(w) > 1, F.try_divide(v - F.avg(v).over(w), F.nullif(sd, F.lit(0.0))))
        elif op == "percentile":
            out = F.when(v.isNotNull(), F.cume_dist().over(Window.partitionBy(*population, v.isNull()).orderBy(v)) * 100)
        else:
            low, high = F.min(v).over(w), F.max(v).over(w)
            out = F.try_divide(v - low, F.nullif(high - low, F.lit(0.0)))
        if not relative:
            return Formula(NONE("double"), F.lit("universe_distribution_required"), (f,), (f,))
        reason = F.when(v.isNull(), F.lit(f"missing_input:{f}")).when(out.isNull(), F.lit(f"universe_distribution_na:{op}:{f}"))
        return Formula(out, reason, (f,), (f,))
    if op == "sum_last_n_quarters":
        f, n = node["field"], node["n"]
        series = F.slice(F.col(f), 1, n)  # newest first
        there = (F.size(series) == n) & F.forall(series, lambda x: x.isNotNull())
        total = F.when(there, F.aggregate(series, F.lit(0.0), lambda a, x: a + x.cast("double")))
        return Formula(total, F.when(F.coalesce(there, F.lit(False)), NONE("string")).otherwise(F.lit(f"insufficient_series:{f}:requested={n},got=0")), (f,))
    if op in BINARY:
        parts = [compiled(node[k], population, relative) for k in ("left", "right")]
        a, b = (p.value for p in parts)
        value = {"add": a + b, "sub": a - b, "mul": a * b}.get(op)
        reason = first_reason(parts)
        if value is None:
            value = F.try_divide(a, F.nullif(b, F.lit(0.0)))
            reason = F.coalesce(reason, F.when(b == 0, F.lit("division_by_zero")))
    else:
        parts = [compiled(x, population, relative) for x in node["args"]]
        values = [p.value for p in parts]
        reason = first_reason(parts)
        if op == "avg":
            value = reduce(lambda a, b: a + b, values) / len(values) if values else NONE("double")
        elif op == "weighted_sum":
            value = reduce(lambda a, b: a + b, [v * literal(w) for v, w in zip(values, node["weights"])])
        else:
            value = F.when(values[0].isNotNull(), F.greatest(F.least(values[0], literal(node["upper"])), literal(node["lower"])))
    inputs = tuple(dict.fromkeys(i for p in parts for i in p.inputs))
    return Formula(F.when(reason.isNull(), value), reason, inputs, tuple(dict.fromkeys(i for p in parts for i in p.relative)))


def read_inputs(node: dict, population: tuple[str, ...] = ("security_type",), relative: bool = True) -> Column:
    """Map of the inputs that an evaluation reads to whether each has a value. Both sides of a binary op are read;
    avg and weighted_sum stop at the first argument without a value."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<boolean>"))
    if "field" in node:
        return F.create_map(F.lit(node["field"]), F.col(node["field"]).isNotNull())
    if "const" in node:
        return none
    both = lambda a, b: F.map_from_entries(F.array_distinct(F.concat(F.map_entries(a), F.map_entries(b))))
    if "left" in node:
        return both(*(read_inputs(node[k], population, relative) for k in ("left", "right")))
    out, go_on = none, F.lit(True)
    for child in node["args"]:
        out = both(out, F.when(go_on, read_inputs(child, population, relative)).otherwise(none))
        go_on = go_on & compiled(child, population, relative).reason.isNull()
    return out


def defects_of(rows: DataFrame, key: str, fields: set[str]) -> DataFrame:
    """key, defect: what is wrong with the JSON trees of the column ``tree``; a text that is no JSON is not_a_node."""
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("found", T.ArrayType(T.StringType()))])

    def of(text: str | None) -> list[str]:
        try:
            return list(dict.fromkeys(defects(json.loads(text or ""), fields)))
        except (json.JSONDecodeError, RecursionError):
            return ["not_a_node"]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], [key, "found"])

    return rows.select(key, F.col("tree").cast("string")).mapInArrow(run, schema).select(key, F.explode("found").alias("defect"))


def with_factors(fields: DataFrame, trees: dict[str, dict], relative: bool = True, population: tuple[str, ...] = ("security_type",)) -> DataFrame:
    """``fields`` with <name>, <name>_reason and, for trees with relative ops, <name>_sample of each tree. Trees may
    use earlier names of the dict as fields (derived factors)."""
    for name, tree in trees.items():
        known = set(fields.columns)
        if wrong := defects(tree, known):
            raise ValueError(f"{name}: {', '.join(wrong)}")
        f = compiled(tree, population, relative)
        columns = {name: f.value, f"{name}_reason": f.reason}
        if f.relative:
            counts = [F.count(F.col(x)).over(Window.partitionBy(*population)) for x in f.relative]
            columns[f"{name}_sample"] = F.least(*counts) if len(counts) > 1 else counts[0]
        fields = fields.withColumns(columns)
    return fields
