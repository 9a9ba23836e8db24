"""The write gate: input rules and references of a request batch, in one pass.

The reference's forms refuse a request before they touch a table: fields that
are missing or no numbers (C4-C8), and, by its foreign keys, stores, books,
cities and publishers that do not exist. ``gate`` compiles both from the
table's metadata into one frame: every request with ``Violations``, the names
of all rules and references it breaks, in order. The write operators pass on
only requests without violations, so a refused request neither takes a key nor
supersedes an earlier one.

A rule is broken unless its condition is TRUE. A reference is broken where its
columns are all there and have no parent row; a missing column breaks no
reference (as in SQL), but mostly a rule.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.parsing import blank_to_null, latin_digits, parse_int, parse_money, strip_all
from inkwell.operators.quality import broken_rules
from inkwell.schemas import MONEY, SCHEMAS, ForeignKey
from inkwell.session import written_table

Tables = Mapping[str, DataFrame]


def typed(requests: DataFrame, table: str) -> DataFrame:
    """The table's columns of staged ``requests`` in the table's types: text
    stripped, numbers in any digits parsed, what cannot be parsed NULL."""
    out = {}
    for f in SCHEMAS[table].fields:
        if f.name not in requests.columns or requests.schema[f.name].dataType == f.dataType and not isinstance(f.dataType, T.StringType):
            continue
        if not isinstance(requests.schema[f.name].dataType, T.StringType):
            out[f.name] = F.col(f.name).cast(f.dataType)
        elif isinstance(f.dataType, T.StringType):
            out[f.name] = blank_to_null(f.name) if f.nullable else strip_all(f.name)
        elif f.dataType == MONEY:
            out[f.name] = parse_money(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            out[f.name] = parse_int(f.name).try_cast(f.dataType)
        else:
            out[f.name] = strip_all(latin_digits(f.name)).try_cast(f.dataType)
    return requests.withColumns(out) if out else requests


def gate(t: Tables, requests: DataFrame, table: str, rules: Mapping[str, Column],
         references: Sequence[ForeignKey] = ()) -> DataFrame:
    """``requests`` with the columns of ``table`` typed, and ``Violations``.

    ``rules`` see the columns as they arrive; ``references`` name request
    columns as ``child_cols``. The requests are the preserved side of every
    join, so a parent row missing or repeated never loses or repeats one. The
    result is a written table: its readers parse and compare nothing again."""
    out = typed(requests.withColumn("Violations", broken_rules(rules)), table)
    named = [c for fk in references for c in fk.child_cols if isinstance(out.schema[c].dataType, T.StringType)]
    if named:       # a blank name is a missing one
        out = out.withColumns({c: blank_to_null(c) for c in named})
    missing = []
    for i, fk in enumerate(references):
        names = [f"_ref{i}_{j}" for j in range(len(fk.parent_cols))]
        parent = (t[fk.parent].select(*[F.col(c).alias(n) for c, n in zip(fk.parent_cols, names)])
                  .distinct().withColumn(f"_found{i}", F.lit(True)))
        on = [out[c] == parent[n] for c, n in zip(fk.child_cols, names)]
        out = out.join(parent, on, "left").drop(*names)
        there = F.lit(True)
        for c in fk.child_cols:
            there = there & F.col(c).isNotNull()
        missing.append(F.when(there & F.col(f"_found{i}").isNull(), F.lit(fk.name)))
    if missing:
        out = (out.withColumn("Violations", F.concat("Violations", F.array_compact(F.array(*missing))))
               .drop(*[f"_found{i}" for i in range(len(references))]))
    # typed and judged once: what passed is read several times, and what did not
    return written_table(out, "gated")


def passed(gated: DataFrame) -> DataFrame:
    return gated.filter(F.size("Violations") == 0).drop("Violations")


def refused(gated: DataFrame, rules: Mapping[str, Column], reasons: Mapping[str, str]) -> DataFrame:
    """The other requests, with ``Reason``: ``invalid_input`` where a rule is
    broken, else the first broken reference's entry in ``reasons``."""
    first = F.element_at("Violations", 1)
    by_reference = F.coalesce(*[F.when(first == name, F.lit(reason)) for name, reason in reasons.items()],
                              F.lit("unknown_reference"))
    reason = F.when(first.isin(list(rules)), F.lit("invalid_input")).otherwise(by_reference)
    return gated.filter(F.size("Violations") > 0).withColumn("Reason", reason)
