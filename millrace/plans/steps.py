"""Operators by name: user functions, SQL over named frames, and declarative lists of steps.

Steps only compose lazy DataFrames; ordering, pushing down and running the work is left to Spark.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.formula import formula
from ..operators import aggregate, columns, contract, filters, fuzzy, graph, joins, numbering, profile
from ..operators import reshape, rows, sets, sorting, windows
from ..sources import custom, jdbc, memory, readers, writers
from ..streaming import incremental


def apply(function: Callable[..., DataFrame], *frames: DataFrame, **settings: Any) -> DataFrame:
    """Call a user function of up to ten frames that returns one frame."""
    if len(frames) > 10:
        raise ValueError("At most ten inputs")
    out = function(*frames, **settings)
    if not isinstance(out, DataFrame):
        raise TypeError(f"The function returned {type(out).__name__}, not a DataFrame")
    return out


def sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """SELECT over frames, each named in braces: ``SELECT * FROM {orders}``."""
    return spark.sql(query, **frames)


def sql_over(*inputs: DataFrame, query: str, names: Sequence[str]) -> DataFrame:
    """The `sql` step: its inputs under the given names."""
    return sql(inputs[0].sparkSession, query, **dict(zip(names, inputs)))


def run_and_read(spark: SparkSession, **settings: Any) -> DataFrame:
    """The `run_incremental` step: take in what is new, then give all that the runs have written."""
    incremental.run_incremental(spark, **settings)
    return incremental.incremental_result(spark, settings["output"])


@dataclass(frozen=True)
class Operator:
    """A step type: a function, how many frames it takes (None: any number), default settings, and their types."""

    function: Callable[..., DataFrame]
    inputs: int | None = 1
    defaults: Mapping[str, Any] = field(default_factory=dict)
    types: Mapping[str, type | tuple[type, ...]] = field(default_factory=dict)

    def checked(self, step_id: str, settings: Mapping[str, Any]) -> dict[str, Any]:
        """The settings over the defaults; unknown names and wrong types raise."""
        unknown = [k for k in settings if k not in self.defaults] if self.defaults else []
        if unknown:
            raise ValueError(f"Step {step_id!r}: unknown settings {', '.join(unknown)}")
        for name, kind in self.types.items():
            value = settings.get(name)
            wanted = kind if isinstance(kind, tuple) else (kind,)
            if value is not None and (not isinstance(value, wanted) or isinstance(value, bool) and bool not in wanted):
                names = " or ".join(k.__name__ for k in wanted)
                raise TypeError(f"Step {step_id!r}: {name} must be {names}, not {type(value).__name__}")
        return {**self.defaults, **settings}


OPERATORS: dict[str, Operator] = {
    "read_csv": Operator(readers.read_csv, 0),
    "read_parquet": Operator(readers.read_parquet, 0),
    "read_json": Operator(readers.read_json, 0),
    "read_dir": Operator(readers.read_dir, 0),
    "read_jdbc": Operator(jdbc.read_jdbc, 0),
    "read_custom": Operator(custom.read_custom, 0),
    "manual_input": Operator(memory.from_rows, 0),
    "from_columns": Operator(memory.from_columns, 0),
    "from_typed": Operator(memory.from_typed, 0),
    "empty": Operator(memory.empty, 0),
    "sequence": Operator(memory.sequence, 0),
    "synthetic_people": Operator(memory.synthetic_people, 0),
    "select": Operator(columns.select_list),
    "rename": Operator(columns.rename),
    "drop": Operator(columns.drop),
    "reorder": Operator(columns.reorder),
    "cast": Operator(columns.cast),
    "to_dates": Operator(columns.to_dates),
    "to_timestamps": Operator(columns.to_timestamps),
    "select_types": Operator(lambda df, types: columns.select_types(df, *types)),
    "formula": Operator(formula),
    "enforce": Operator(contract.enforce),
    "filter": Operator(filters.basic_filter),
    "filter_expr": Operator(filters.filter_expr),
    "join": Operator(joins.join, 2),
    "cross_join": Operator(joins.cross_join, 2),
    "join_row_count": Operator(joins.join_row_count, 2),
    "fuzzy_match": Operator(fuzzy.fuzzy_join, 2),
    "group_by": Operator(aggregate.group_by),
    "record_count": Operator(aggregate.record_count),
    "pivot": Operator(reshape.pivot),
    "unpivot": Operator(reshape.unpivot),
    "window": Operator(windows.window),
    "record_id": Operator(numbering.record_id),
    "sort": Operator(sorting.sort),
    "head": Operator(sorting.head),
    "every_nth": Operator(sorting.every_nth),
    "shuffled_sample": Operator(sorting.shuffled_sample),
    "union": Operator(sets.union, None),
    "unique": Operator(sets.unique),
    "differences": Operator(sets.differences, 2),
    "text_to_rows": Operator(rows.text_to_rows),
    "graph_solver": Operator(graph.connected_groups),
    "explore_data": Operator(profile.explore_sample),
    "profile": Operator(profile.profile),
    "profile_summary": Operator(profile.profile_summary),
    "column_stats": Operator(profile.column_stats),
    "column_flags": Operator(profile.column_flags),
    "field_roles": Operator(profile.field_roles),
    "map_batches": Operator(sorting.map_batches),
    "apply": Operator(lambda *frames, function, **settings: apply(function, *frames, **settings), None),
    "run_incremental": Operator(run_and_read, 0),
    "sql": Operator(sql_over, None),
    "materialise": Operator(writers.materialise),
}

# Step types that end a list: they write their input and have no result.
SINKS: dict[str, Callable[..., None]] = {
    "write_csv": writers.write_csv,
    "write_parquet": writers.write_parquet,
    "write_json": writers.write_json,
    "write_jdbc": jdbc.write_jdbc,
}


def register(
    name: str,
    function: Callable[..., DataFrame],
    inputs: int | None = 1,
    defaults: Mapping[str, Any] | None = None,
    types: Mapping[str, type | tuple[type, ...]] | None = None,
) -> None:
    """Make a user function available as a step type.

    Settings are checked against the defaults by name and, where `types` names one or several Python
    types, by type; a null setting fits every type.
    """
    if name in OPERATORS:
        raise ValueError(f"Step type {name!r} exists already")
    strange = [k for k in types or {} if k not in (defaults or {})]
    if strange:
        raise ValueError(f"Types without a default: {', '.join(strange)}")
    OPERATORS[name] = Operator(function, inputs, dict(defaults or {}), dict(types or {}))


@dataclass(frozen=True)
class Step:
    id: str
    type: str
    settings: Mapping[str, Any] = field(default_factory=dict)
    inputs: Sequence[str] = ()


class Steps:
    """A declarative list of steps. Each names its type, its settings and its inputs by id.

    Steps may be listed in any order. Inputs keep their order, so the first is the left side.
    """

    def __init__(self, steps: Sequence[Step | Mapping[str, Any]]):
        listed = [s if isinstance(s, Step) else Step(**{**s, "id": str(s["id"])}) for s in steps]
        self.steps = {s.id: s for s in listed}
        if len(self.steps) != len(listed):
            raise ValueError("Step ids must be unique")
        for s in listed:
            if s.type not in OPERATORS and s.type not in SINKS:
                known = ", ".join(sorted([*OPERATORS, *SINKS]))
                raise ValueError(f"Step {s.id!r}: unknown type {s.type!r}; one of {known}")
            wanted = 1 if s.type in SINKS else OPERATORS[s.type].inputs
            if wanted is not None and len(s.inputs) != wanted:
                raise ValueError(f"Step {s.id!r} ({s.type}) takes {wanted} inputs, not {len(s.inputs)}")

    @classmethod
    def from_json(cls, text: str) -> Steps:
        return cls(json.loads(text))

    def frame(self, spark: SparkSession, step_id: str | int, **given: DataFrame) -> DataFrame:
        """The lazy result of one step; `given` supplies frames for inputs that are no steps."""
        return self._build(spark, str(step_id), dict(given), ())

    def frames(self, spark: SparkSession, *step_ids: str | int, **given: DataFrame) -> dict[str, DataFrame]:
        """Results of several steps; steps they share are built once."""
        built = dict(given)
        return {str(i): self._build(spark, str(i), built, ()) for i in step_ids}

    def run(self, spark: SparkSession, **given: DataFrame) -> list[str]:
        """Write every sink, one Spark job each, and return their ids."""
        built, sinks = dict(given), [s for s in self.steps.values() if s.type in SINKS]
        for s in sinks:
            SINKS[s.type](self._build(spark, str(s.inputs[0]), built, (s.id,)), **s.settings)
        return [s.id for s in sinks]

    def _build(self, spark: SparkSession, step_id: str, built: dict[str, DataFrame], above: tuple[str, ...]) -> DataFrame:
        if step_id in built:
            return built[step_id]
        if step_id in above:
            raise ValueError(f"Steps feed themselves: {' -> '.join((*above, step_id))}")
        if step_id not in self.steps:
            raise ValueError(f"Unknown step or frame {step_id!r}")
        step = self.steps[step_id]
        if step.type in SINKS:
            raise ValueError(f"Step {step_id!r} writes and has no result; use run")
        operator = OPERATORS[step.type]
        inputs = [self._build(spark, str(i), built, (*above, step_id)) for i in step.inputs]
        settings = operator.checked(step_id, step.settings)
        leading = inputs if operator.inputs != 0 else [spark]
        built[step_id] = operator.function(*leading, **settings)
        return built[step_id]
