"""Data-quality checks (C1-C19), each a predicate over a DataFrame.

Table rules (keys, references, CHECK constraints, NOT NULL and the business
rules of the entity diagram) come from ``inkwell.schemas``; each returns the
violating rows, ``tagged`` gives a table's rows with the names of all rules
they break, and ``quality_summary`` counts all rules in one frame.
Input rules (C1-C8) tag staged text rows with an array of violated rule
names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from inkwell.functions.parsing import parse_date, parse_int, parse_money, strip_all
from inkwell.schemas import (CHECKS, FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, Check, ForeignKey,
                             not_null_columns)
from inkwell.session import written_table

Tables = Mapping[str, DataFrame]


# --- table rules ---------------------------------------------------------------
def duplicate_keys(t: Tables, table: str) -> DataFrame:
    """Primary-key values that occur more than once, with their count."""
    pk = list(PRIMARY_KEYS[table])
    return (t[table].groupBy(*pk).agg(F.count(F.lit(1)).alias("Occurrences"))
            .filter(F.col("Occurrences") > 1))


def orphans(t: Tables, fk: ForeignKey) -> DataFrame:
    """C14: child rows whose (non-NULL) reference has no parent row."""
    child = t[fk.child]
    for c in fk.child_cols:
        child = child.filter(F.col(c).isNotNull())
    parent = t[fk.parent].select(*[F.col(p).alias(c) for p, c in zip(fk.parent_cols, fk.child_cols)])
    return child.join(parent.distinct(), list(fk.child_cols), "left_anti")


def orphan_counts(t: Tables, fk: ForeignKey) -> DataFrame:
    """C14 as counts: (reference value, child rows) for references without a
    parent. Child rows are counted per key before the anti join, so the join
    shuffles one row per distinct key instead of one per child row."""
    child = t[fk.child]
    for c in fk.child_cols:
        child = child.filter(F.col(c).isNotNull())
    per_key = child.groupBy(*fk.child_cols).agg(F.count(F.lit(1)).alias("_rows"))
    parent = t[fk.parent].select(*[F.col(p).alias(c) for p, c in zip(fk.parent_cols, fk.child_cols)])
    return per_key.join(parent.distinct(), list(fk.child_cols), "left_anti")


def check_failures(t: Tables, check: Check) -> DataFrame:
    """Rows where the CHECK condition is FALSE (NULL passes)."""
    return t[check.table].filter(F.expr(f"NOT coalesce({check.condition}, true)"))


def null_violations(t: Tables, table: str) -> DataFrame:
    """C11: rows with NULL in a NOT NULL column."""
    cols = not_null_columns(table)
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.col(c).isNull()
    return t[table].filter(cond)


def sales_without_items(t: Tables) -> DataFrame:
    """Invoices with no line."""
    return t["Sale"].join(t["SaleItem"].select("InvoiceNumber").distinct(), "InvoiceNumber", "left_anti")


def managers_outside_store(t: Tables) -> DataFrame:
    """Stores whose manager is not an employee of that same store."""
    emp = t["Employee"].select(F.col("NationalCode").alias("ManagerNationalCode"), "StoreCode")
    return (t["Store"].filter(F.col("ManagerNationalCode").isNotNull())
            .join(emp, ["ManagerNationalCode", "StoreCode"], "left_anti"))


def managers_of_several_stores(t: Tables) -> DataFrame:
    """C17: employees named manager of more than one store."""
    return (t["Store"].filter(F.col("ManagerNationalCode").isNotNull())
            .groupBy("ManagerNationalCode").agg(F.count(F.lit(1)).alias("Stores"))
            .filter(F.col("Stores") > 1))


def sellers_outside_store(t: Tables) -> DataFrame:
    """Sales recorded by someone who is not an employee of the selling
    store."""
    emp = t["Employee"].select(F.col("NationalCode").alias("EmployeeNationalCode"), "StoreCode")
    return t["Sale"].join(emp, ["EmployeeNationalCode", "StoreCode"], "left_anti")


# --- all rules in one pass -----------------------------------------------------
#: Rules between tables that are no references: rule -> table it counts in.
BUSINESS_RULES = {
    "sale_has_items": "Sale", "manager_in_store": "Store", "manager_of_one_store": "Store", "seller_in_store": "Sale",
}
#: Keys that are no table's: the pairs (national code, store) of Employee, and managers.
_STAFF, _MANAGER = "staff of store", "manager"


def _key(cols: Sequence[str], owner: str) -> list[Column]:
    """The columns of a key value, of the types they have in the table that
    owns the key; NULL is a value of its own."""
    of = SCHEMAS["Employee" if owner in (_STAFF, _MANAGER) else owner]
    owned = {_STAFF: ("NationalCode", "StoreCode"), _MANAGER: ("NationalCode",)}.get(owner) or PRIMARY_KEYS[owner]
    return [F.col(c).cast(of[o].dataType).alias(f"Key{i}") for i, (c, o) in enumerate(zip(cols, owned))]


def _present_all(cols: Sequence[str]) -> Column:
    there = F.lit(True)
    for c in cols:
        there = there & F.col(c).isNotNull()
    return there


def _facts_of(table: str, names: tuple[str, ...]) -> list[tuple[str, Sequence[str], str, Column | None]]:
    """What a row of ``table`` says about keys: (owner of the key, its columns
    here, fact, where it says so; None: everywhere). Fact ``row``: the owner's
    row itself; else the rule by which the row names the key."""
    facts = [(table, PRIMARY_KEYS[table], "row", None)]
    facts += [(fk.parent, fk.child_cols, f"fk_{fk.name}", _present_all(fk.child_cols))
              for fk in FOREIGN_KEYS if fk.child == table and fk.parent in names]
    if table == "Employee":
        facts.append((_STAFF, ("NationalCode", "StoreCode"), "row", _present_all(("NationalCode", "StoreCode"))))
    if table == "Store":
        managed = F.col("ManagerNationalCode").isNotNull()
        facts.append((_STAFF, ("ManagerNationalCode", "StoreCode"), "manager_in_store", managed))
        facts.append((_MANAGER, ("ManagerNationalCode",), "manager_of_one_store", managed))
    if table == "Sale":
        facts.append((_STAFF, ("EmployeeNationalCode", "StoreCode"), "seller_in_store", None))
    return facts


def _as_rows(totals: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(Rule, TableName, Violations) from one row with a column per rule."""
    return totals.select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("Rule"), F.lit(tb).alias("TableName"), F.coalesce(F.col(r), F.lit(0)).cast("bigint").alias("Violations"))
        for r, tb in rules])).alias("r")).select("r.*")


def quality_summary(t: Tables, tables: tuple[str, ...] | None = None) -> DataFrame:
    """All table rules with their violation counts, one row per rule.

    NULLs and CHECKs are counted row by row. For every key (its owner's, or
    pairs of staff and store, or managers) the tables that hold or name it say
    so with its columns alone; these facts are counted per key, before and
    after one shuffle per owner (so a key that many rows name travels once per
    task, and a task holds the counts of one owner's keys only). A key's
    counts tell all rules about it: rows > 1 is a repeated key, names without
    rows are orphans, rows without names a sale without items.
    """
    names = tables or tuple(SCHEMAS)
    said: dict[str, list[tuple[str, Sequence[str], str, Column | None]]] = {}    # owner -> (table, columns, fact, where)
    for tb in names:
        for owner, cols, fact, where in _facts_of(tb, names):
            said.setdefault(owner, []).append((tb, cols, fact, where))

    # rule -> (table it counts in, owner of its keys, count of a key's violations)
    orphans_of = lambda fact: F.when(F.col("row") == 0, F.col(fact))
    rules = {f"pk_{tb}": (tb, tb, F.when(F.col("row") > 1, 1)) for tb in names}
    rules |= {f"fk_{fk.name}": (fk.child, fk.parent, orphans_of(f"fk_{fk.name}"))
              for fk in FOREIGN_KEYS if fk.child in names and fk.parent in names}
    between = {
        "sale_has_items": ({"Sale", "SaleItem"}, "Sale", F.when(F.col("fk_saleitem_sale") == 0, F.col("row"))),
        "manager_in_store": ({"Store", "Employee"}, _STAFF, orphans_of("manager_in_store")),
        "manager_of_one_store": ({"Store"}, _MANAGER, F.when(F.col("manager_of_one_store") > 1, 1)),
        "seller_in_store": ({"Sale", "Employee"}, _STAFF, orphans_of("seller_in_store")),
    }
    rules |= {r: (BUSINESS_RULES[r], owner, col) for r, (needs, owner, col) in between.items() if needs <= set(names)}

    out = []
    for tb in names:
        broken = {f"not_null_{tb}": ~_present_all(not_null_columns(tb))}
        broken |= {f"check_{c.name}": F.expr(f"NOT coalesce({c.condition}, true)") for c in CHECKS if c.table == tb}
        totals = t[tb].agg(*[F.count(F.when(cond, 1)).alias(r) for r, cond in broken.items()])
        out.append(_as_rows(totals, [(r, tb) for r in broken]))
    for owner, facts in said.items():
        about = {r: (tb, col) for r, (tb, of, col) in rules.items() if of == owner}
        if not about:
            continue
        slots = list(dict.fromkeys(["row", *(fact for _, _, fact, _ in facts)]))
        told = [(t[tb] if where is None else t[tb].filter(where)).select(*_key(cols, owner), F.lit(slots.index(fact)).alias("Slot"))
                for tb, cols, fact, where in facts]
        per_key = (reduce(DataFrame.unionByName, told).groupBy(*[c for c in told[0].columns if c != "Slot"])
                   .agg(*[F.count(F.when(F.col("Slot") == i, 1)).alias(fact) for i, fact in enumerate(slots)]))
        totals = per_key.agg(*[F.sum(col).alias(r) for r, (_, col) in about.items()])
        out.append(_as_rows(totals, [(r, tb) for r, (tb, _) in about.items()]))
    return reduce(DataFrame.unionByName, out)


# --- rows with the rules they break --------------------------------------------
def rules_of(table: str) -> list[str]:
    """Names of the table's rules, in the order of ``Violations``."""
    return ([f"pk_{table}", f"not_null_{table}"]
            + [f"check_{c.name}" for c in CHECKS if c.table == table]
            + [f"fk_{fk.name}" for fk in FOREIGN_KEYS if fk.child == table]
            + [r for r, tb in BUSINESS_RULES.items() if tb == table])


def _broken_keys(t: Tables, table: str) -> list[tuple[tuple[str, ...], DataFrame]]:
    """(columns of the table, the values of them that break a rule): one frame
    per set of columns, with a boolean column per rule on these columns. The
    rows that hold a value and the parents that have it are counted per value
    before and after one shuffle, so a value that many rows share travels once
    per task, and the rules on one set of columns share the shuffle."""
    pk = tuple(PRIMARY_KEYS[table])
    # columns -> [(rule, parent, its columns, whether NULLs break the rule)]
    named: dict[tuple[str, ...], list[tuple[str, str, tuple[str, ...], bool]]] = {pk: []}

    def without_parent(rule, cols, parent, parent_cols, nulls=False):
        named.setdefault(tuple(cols), []).append((rule, parent, tuple(parent_cols), nulls))

    for fk in FOREIGN_KEYS:
        if fk.child == table:
            without_parent(f"fk_{fk.name}", fk.child_cols, fk.parent, fk.parent_cols)
    if table == "Sale":
        without_parent("sale_has_items", ("InvoiceNumber",), "SaleItem", ("InvoiceNumber",), nulls=True)
        without_parent("seller_in_store", ("EmployeeNationalCode", "StoreCode"), "Employee", ("NationalCode", "StoreCode"), nulls=True)
    if table == "Store":
        without_parent("manager_in_store", ("ManagerNationalCode", "StoreCode"), "Employee", ("NationalCode", "StoreCode"))
        named.setdefault(("ManagerNationalCode",), [])

    out = []
    for cols, rules in named.items():
        said = t[table].select(*cols, F.lit(-1).alias("_by"))
        for i, (_, parent, parent_cols, _) in enumerate(rules):
            has = t[parent].select(*[F.col(p).cast(t[table].schema[c].dataType).alias(c) for p, c in zip(parent_cols, cols)])
            # in SQL a NULL is no value that a row has
            said = said.unionByName(has.filter(_present_all(cols)).withColumn("_by", F.lit(i)))
        counted = said.groupBy(*cols).agg(F.count(F.when(F.col("_by") == -1, 1)).alias("_rows"),
                                          *[F.max(F.col("_by") == i).alias(f"_has{i}") for i in range(len(rules))])
        broken = {rule: ~F.col(f"_has{i}") & (F.lit(True) if nulls else _present_all(cols))
                  for i, (rule, _, _, nulls) in enumerate(rules)}
        if cols == pk:
            broken[f"pk_{table}"] = F.col("_rows") > 1
        if table == "Store" and cols == ("ManagerNationalCode",):
            broken["manager_of_one_store"] = (F.col("_rows") > 1) & _present_all(cols)
        keys = counted.filter(F.col("_rows") > 0).select(*cols, *[cond.alias(rule) for rule, cond in broken.items()])
        out.append((cols, keys.filter(reduce(lambda a, b: a | b, [F.col(r) for r in broken]))))
    return out


def tagged(t: Tables, table: str) -> DataFrame:
    """C9-C18 as rows: the table with ``Violations``, the names of the rules
    each row breaks (empty for a sound row), in the order of ``rules_of``. All
    rows of a repeated key break ``pk_*``; all stores of a shared manager break
    ``manager_of_one_store``."""
    broken: dict[str, Column] = {f"not_null_{table}": ~_present_all(not_null_columns(table))}
    broken |= {f"check_{c.name}": F.expr(f"NOT coalesce({c.condition}, true)") for c in CHECKS if c.table == table}
    cols = t[table].columns
    out = t[table]
    for i, (on, keys) in enumerate(_broken_keys(t, table)):
        # The few broken keys, under names of their own; equal NULLs match.
        # Written, so that the planner knows how few they are and need not
        # shuffle the table for each set of columns.
        rules = [c for c in keys.columns if c not in on]
        bad = written_table(keys.select(*[F.col(c).alias(f"_bad{i}_{j}") for j, c in enumerate(on)],
                                        *[F.col(r).alias(f"_{r}") for r in rules]), "broken")
        match = reduce(lambda a, b: a & b, [out[c].eqNullSafe(bad[f"_bad{i}_{j}"]) for j, c in enumerate(on)])
        out = out.join(bad, match, "left")
        broken |= {r: F.coalesce(F.col(f"_{r}"), F.lit(False)) for r in rules}
    names = F.array_compact(F.array(*[F.when(broken[r], F.lit(r)) for r in rules_of(table)]))
    return out.select(*cols, names.alias("Violations"))


def write_violations(t: Tables, root: str, tables: tuple[str, ...] | None = None) -> dict[str, int]:
    """Write the rows that break a rule, with their ``Violations``, to
    ``root/<Table>``, and return the rows per rule. Counted by an observation
    while the rows are written, so each table is read for both at once."""
    counts: dict[str, int] = {}
    for table in tables or tuple(SCHEMAS):
        seen = Observation(f"violations of {table}")
        counted = [F.count(F.when(F.array_contains("Violations", r), 1)).alias(r) for r in rules_of(table)]
        tagged(t, table).observe(seen, *counted).filter(F.size("Violations") > 0).write.mode("overwrite").parquet(f"{root}/{table}")
        counts |= seen.get
    return counts


# --- input rules ---------------------------------------------------------------
def broken_rules(rules: Mapping[str, Column]) -> Column:
    """Names of the rules whose condition is not TRUE, in order."""
    flags = [F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]
    return F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")


def _present(c: str) -> Column:
    return F.length(strip_all(F.col(c))) > 0


def sale_line_rules() -> dict[str, Column]:
    """C1-C3 on text columns StoreCode, CustomerCode, EmployeeNationalCode,
    InvoiceDate, ISBN, Quantity."""
    return {
        "date_format": parse_date("InvoiceDate").isNotNull(),
        "quantity_positive_int": parse_int("Quantity") > 0,
        "store_present": _present("StoreCode"),
        "customer_present": _present("CustomerCode"),
        "employee_present": _present("EmployeeNationalCode"),
        "book_present": _present("ISBN"),
    }


def inventory_rules() -> dict[str, Column]:
    """C4: AvailableQuantity and MinimumQuantity are integers >= 0."""
    return {
        "available_nonnegative_int": parse_int("AvailableQuantity") >= 0,
        "minimum_nonnegative_int": parse_int("MinimumQuantity") >= 0,
    }


def inventory_key_rules() -> dict[str, Column]:
    """Store and book are chosen."""
    return {"store_present": _present("StoreCode"), "book_present": _present("ISBN")}


def book_rules(authors: Column) -> dict[str, Column]:
    """C5-C7 on ISBN, Title, Subject, PublisherName, Price, PublicationYear;
    ``authors``: the array of names."""
    year = parse_int("PublicationYear")
    blank_year = F.coalesce(strip_all(F.col("PublicationYear")), F.lit("")) == ""
    return {
        "isbn_present": _present("ISBN"),
        "title_present": _present("Title"),
        "subject_present": _present("Subject"),
        "author_present": F.size(authors) > 0,
        "publisher_present": _present("PublisherName"),
        "price_nonnegative_decimal": parse_money("Price") >= 0,
        "year_range": blank_year | year.between(1000, 9999),
    }


def store_rules() -> dict[str, Column]:
    """Store code an integer > 0; city, phone, address present."""
    return {
        "store_code_positive_int": parse_int("StoreCode") > 0,
        "city_present": _present("CityCode"),
        "phone_present": _present("Phone"),
        "address_present": _present("Address"),
    }


def validate_sale_lines(df: DataFrame) -> DataFrame:
    """Sale request lines with ``Violations``, the rules of C1-C3 they break."""
    return df.withColumn("Violations", broken_rules(sale_line_rules()))


def validate_inventory_input(df: DataFrame) -> DataFrame:
    """Inventory form rows with ``Violations`` (C4)."""
    return df.withColumn("Violations", broken_rules(inventory_rules()))


def validate_book_input(df: DataFrame) -> DataFrame:
    """Book form rows (Authors an array) with ``Violations``."""
    return df.withColumn("Violations", broken_rules(book_rules(F.col("Authors"))))


def validate_store_input(df: DataFrame) -> DataFrame:
    """Store form rows with ``Violations``."""
    return df.withColumn("Violations", broken_rules(store_rules()))


def with_paid_default(df: DataFrame) -> DataFrame:
    """PaidAmount defaults to 0 on ingestion."""
    return df.withColumn("PaidAmount", F.coalesce(F.col("PaidAmount"),
                                                  F.lit(0).cast(SCHEMAS["PublisherPurchase"]["PaidAmount"].dataType)))
