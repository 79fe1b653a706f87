"""The registry of questions: each a function of Facts, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources.project import Facts, with_facts

QUESTIONS: dict[str, Callable[[Facts], DataFrame]] = {}
SQL: dict[str, str] = {}


def question(sql: str | None = None):
    def add(f: Callable[[Facts], DataFrame]):
        if f.__name__ in QUESTIONS:
            raise ValueError(f"{f.__name__} is there already")
        QUESTIONS[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_facts(sql)
        return f

    return add


def ask(spark, sf_dir: str, name: str) -> DataFrame:
    return QUESTIONS[name](Facts(spark, sf_dir))


def queries() -> dict:
    from . import control, devices, filters, forward, paths, questions, resolving, ribs, sessions, symbolics  # noqa: F401  they fill the registry

    return {name: (lambda spark, sf_dir, f=f: f(Facts(spark, sf_dir))) for name, f in QUESTIONS.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


@dataclass(frozen=True)
class Variable:
    """A parameter of a question: its type, whether it may be left out, and the values or the specifier kind that it takes."""

    name: str
    type: type = str
    optional: bool = True
    allowed: tuple = ()
    kind: str | None = None
    description: str = ""

    def check(self, value):
        if value is None:
            if not self.optional:
                raise ValueError(f"{self.name} has to be given")
            return None
        if not isinstance(value, self.type) or isinstance(value, bool) and self.type is not bool:
            raise ValueError(f"{self.name} must be of type {self.type.__name__}")
        if self.allowed and value not in self.allowed:
            raise ValueError(f"{self.name} must be one of {', '.join(map(str, self.allowed))}")
        return value


#: What every answer can be asked with.
VARIABLES = [
    Variable("nodes", kind="node", description="nodes whose rows are wanted, for answers with a column node or hostname"),
    Variable("columns", list, description="columns of the answer, in this order"),
    Variable("filters", list, description="comparisons (column, operator, value)"),
    Variable("exclusions", list, description="objects; rows that one of them covers are left out"),
    Variable("sort", list, description="(column, reversed) pairs"),
    Variable("unique", bool, description="each row once"),
    Variable("offset", int, description="rows that are passed over"),
    Variable("rows", int, description="rows at most"),
]


def answer(spark, sf_dir: str, name: str, **given) -> DataFrame:
    """A question's answer with parameters: see VARIABLES.  Unknown questions, parameters and columns are errors."""
    from ..operators import answers, tables
    from . import specifiers

    known = {v.name: v for v in VARIABLES}
    if wrong := set(given) - set(known):
        raise ValueError(f"unknown parameters: {', '.join(sorted(wrong))}")
    p = {k: known[k].check(v) for k, v in given.items()}
    queries()
    if name not in QUESTIONS:
        raise ValueError(f"no question {name}")
    facts = Facts(spark, sf_dir)
    df = QUESTIONS[name](facts)
    if p.get("nodes"):
        on = next((c for c in ("node", "hostname") if c in df.columns), None)
        if on is None:
            raise ValueError(f"{name} has no nodes")
        df = df.join(specifiers.nodes(facts.node, p["nodes"]).select(on).distinct(), on, "left_semi")
    if p.get("exclusions"):
        df = answers.uncovered(df, p["exclusions"])
    for c, _, _ in p.get("filters") or []:
        if c not in df.columns:
            raise ValueError(f"no column {c}; there are {', '.join(df.columns)}")
    return tables.row_options(df, p.get("columns"), [tables.predicate(*f) for f in p.get("filters") or []], p.get("unique") or False, p.get("sort") or [], p.get("offset") or 0, p.get("rows"))


def answer_diff(spark, sf_dir: str, reference_dir: str, name: str, keys: list[str], one_sided: bool = True, **given) -> DataFrame:
    """What a question answers differently on two snapshots, under equal keys."""
    from ..operators import tables

    return tables.table_diff(answer(spark, sf_dir, name, **given), answer(spark, reference_dir, name, **given), keys, one_sided)
