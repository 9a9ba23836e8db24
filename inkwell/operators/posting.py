"""Posting sales and stock changes as batch jobs.

The reference posts one invoice at a time inside a transaction. Here a batch
of requests is posted with the same outcome as posting them one by one in
arrival order (``RequestID``):

* An invoice is accepted only if every line finds its (store, ISBN) stock row
  with ``AvailableQuantity >= Quantity`` at its turn; otherwise the whole
  invoice is cancelled and leaves no trace (no stock change, no number).
* Accepted invoices get numbers ``max(existing) + 1, + 2, ...`` in arrival
  order, with no gaps for cancelled ones (W2), and lines 1..n (W3).

Plan (exact w.r.t. the sequential semantics; stock only falls in a batch):

1. Lines with no header, no stock row, no book or more than the starting
   stock can never succeed: their invoices are rejected at once.
2. Summing the remaining demand per (store, ISBN): pairs whose demand fits
   the stock are *uncontested*; an invoice touching only such pairs is
   accepted whatever the order.
3. Only invoices touching a contested pair are decided in order, with only
   their contested lines. Where a store has more than ``chunk`` of them, most
   are decided by bounds first: the demand before a line lies between that of
   the accepted invoices and that of the accepted and undecided ones, so an
   invoice is accepted if all its lines fit under the upper bound and refused
   if one does not fit under the lower. A round decides all stores and all
   invoices at once, and the bounds of the next one are tighter.
4. What stays undecided is replayed in order, per store (cogrouped
   ``applyInPandas`` over hash buckets of stores).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.ordinal import number_in_blocks, number_within, with_ordinal
from inkwell.operators import sequential
from inkwell.operators.sequential import bounded_walk
from inkwell.schemas import MONEY, MONEY_SUM
from inkwell.session import ensure_checkpoint_dir, written_table

Tables = Mapping[str, DataFrame]

#: Contested invoices of one store that a task replays at most.
DEFAULT_CHUNK = 200_000
#: Lines of one stock row that a task sums in order.
BLOCK_LINES = 16_384

# Reasons a request is refused.
NO_LINES = "no_lines"
MISSING_HEADER = "missing_header"
INVALID_QUANTITY = "invalid_quantity"
NO_STOCK_ROW = "no_stock_row"
INSUFFICIENT_STOCK = "insufficient_stock"
NOT_SELLABLE = "not_sellable"
INVALID_AMOUNT = "invalid_amount"

HEADER_COLS = ("RequestID", "StoreCode", "CustomerCode", "EmployeeNationalCode", "InvoiceDate")


@dataclass
class PostingResult:
    """The outcome of a batch. Frames are made when they are first read: the
    numbers of invoices are not given out for a reader of the stock alone."""

    t: Tables
    lines: DataFrame                  # as requested
    parts: Mapping[str, DataFrame]    # of ``classify_requests``
    decided: DataFrame                # (RequestID, Accepted) of contested requests

    @cached_property
    def _refused(self) -> DataFrame:
        return self.decided.filter(~F.col("Accepted")).select("RequestID")

    @cached_property
    def rejected(self) -> DataFrame:
        """(RequestID, Reason)"""
        return self.parts["rejected"].unionByName(self._refused.withColumn("Reason", F.lit(INSUFFICIENT_STOCK)))

    @cached_property
    def _headers(self) -> DataFrame:
        # an invoice that is not contested was accepted
        return self.parts["headers"].join(self._refused, "RequestID", "left_anti")

    @cached_property
    def accepted(self) -> DataFrame:
        """(RequestID, InvoiceNumber), W2: numbers continue from the current
        maximum, in arrival order."""
        base = self.t["Sale"].select(F.coalesce(F.max("InvoiceNumber"), F.lit(0)).cast("long")).scalar()
        return (with_ordinal(self._headers.select("RequestID"), ["RequestID"], "InvoiceNumber", start=base + F.lit(1))
                .select("RequestID", "InvoiceNumber"))

    @cached_property
    def sales(self) -> DataFrame:
        """New Sale rows."""
        return (self._headers.join(self.accepted, "RequestID")
                .select("InvoiceNumber", "InvoiceDate", "CustomerCode", "StoreCode", "EmployeeNationalCode"))

    @cached_property
    def items(self) -> DataFrame:
        """New SaleItem rows, W3: lines 1..n by form position; W4 price: the
        book price at posting time."""
        price = (_unit_price(self.lines, self.parts["live_lines"].join(self.accepted, "RequestID"))
                 .select("InvoiceNumber", "LinePos", "ISBN", F.col("Quantity").cast("int"), F.col("UnitPrice").cast(MONEY)))
        return (number_in_blocks(price, ["InvoiceNumber"], "LinePos", ["ISBN"], "LineNumber")
                .select("InvoiceNumber", "LineNumber", "ISBN", "Quantity", "UnitPrice"))

    @cached_property
    def inventory(self) -> DataFrame:
        """Inventory after the batch."""
        used = (self.parts["live_lines"].join(self._refused, "RequestID", "left_anti")
                .groupBy("StoreCode", "ISBN").agg(F.sum("Quantity").alias("_used")))
        return _apply_usage(self.t["Inventory"], used, sign=-1)


# --- W1 replay ------------------------------------------------------------------
_REPLAY_SCHEMA = T.StructType([T.StructField("RequestID", T.LongType()),
                               T.StructField("Accepted", T.BooleanType())])


def _replay_stores_fn():
    """The ordered replay, built as a nested function: Spark pickles nested
    functions with their code, so executors need only pandas, not this
    package."""
    import pandas as pd

    def _replay_stores(lines: pd.DataFrame, stock: pd.DataFrame) -> pd.DataFrame:
        """The undecided lines of the stores of one hash bucket; each store's
        invoices in arrival order (stores never share stock). ``Used`` is the
        demand of accepted invoices before the line that are not among them."""
        ids: list[int] = []
        acc: list[bool] = []
        if len(lines):
            avail = [int(q) for q in stock["Available"]] + [-1]       # the last: no stock row
            rows = stock.assign(_row=range(len(stock)))[["_sstore", "_sisbn", "_row"]]
            lines = (lines.merge(rows, how="left", left_on=["StoreCode", "ISBN"], right_on=["_sstore", "_sisbn"])
                     .sort_values(["StoreCode", "RequestID"], kind="stable"))
            row = lines["_row"].fillna(len(stock)).astype("int64").tolist()
            rid, qty, used = (lines[c].astype("int64").tolist() for c in ("RequestID", "Quantity", "Used"))
            start, n = 0, len(lines)
            while start < n:
                end, ok = start, True
                while end < n and rid[end] == rid[start]:
                    ok = ok and avail[row[end]] - used[end] >= qty[end]
                    end += 1
                if ok:      # one line per book of an invoice
                    for i in range(start, end):
                        avail[row[i]] -= qty[i]
                ids.append(rid[start])
                acc.append(ok)
                start = end
        return pd.DataFrame({"RequestID": pd.Series(ids, dtype="int64"), "Accepted": pd.Series(acc, dtype=bool)})

    return _replay_stores


def _cogroup_replay(lines: DataFrame, stock: DataFrame) -> DataFrame:
    # Stores are hashed into a bounded number of buckets so that one pandas
    # call handles many of them; fresh column names on the stock side (both
    # sides derive from one plan).
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    ln = lines.withColumn("_bucket", F.pmod(F.hash("StoreCode"), F.lit(n)))
    st = (stock.select(F.col("StoreCode").alias("_sstore"), F.col("ISBN").alias("_sisbn"), "Available",
                       F.pmod(F.hash("StoreCode"), F.lit(n)).alias("_sbucket")))
    return (ln.groupBy("_bucket").cogroup(st.groupBy("_sbucket"))
            .applyInPandas(_replay_stores_fn(), _REPLAY_SCHEMA))


_PAIR = ["StoreCode", "ISBN"]


def _with_bounds(work: DataFrame) -> DataFrame:
    """The undecided lines of ``work`` with ``Used`` and ``_open``: the demand
    of the accepted and of the undecided invoices before the line on its stock
    row. A stock row may hold any share of the lines: they lie in blocks, sums
    are pre-aggregated per block, and only a block is ordered by one task."""
    at = [*_PAIR, "_block"]
    taken = F.when(F.col("_accepted"), F.col("Quantity")).otherwise(F.lit(0))
    asked = F.when(F.col("_accepted"), F.lit(0)).otherwise(F.col("Quantity"))
    before = Window.partitionBy(*_PAIR).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*at).orderBy("RequestID").rowsBetween(Window.unboundedPreceding, -1)

    def earlier(col, window):
        return F.coalesce(F.sum(col).over(window), F.lit(0))

    sums = work.groupBy(*at).agg(F.sum(taken).alias("_t"), F.sum(asked).alias("_a"))
    offsets = sums.select(*at, earlier("_t", before).alias("_t"), earlier("_a", before).alias("_a"))
    return (work.join(offsets, at)
            .withColumn("Used", F.col("Used") + F.col("_t") + earlier(taken, inside))
            .withColumn("_open", F.col("_a") + earlier(asked, inside))
            .filter(~F.col("_accepted")).drop("_t", "_a", "_accepted"))


def decide_by_bounds(lines: DataFrame, stock: DataFrame, enough: int) -> tuple[DataFrame, DataFrame, int]:
    """Rounds of bounds on contested ``lines`` (StoreCode, RequestID, ISBN,
    Quantity) against ``stock`` (StoreCode, ISBN, Available).

    Returns the decided invoices (RequestID, Accepted), the lines of the
    others, with ``Used`` (the demand of accepted invoices before the line),
    and the most undecided invoices of a store. Ends when no store has more
    than ``enough`` undecided invoices, or when two rounds (one mostly accepts,
    the next refuses what then no longer fits) decide no more than ``enough``:
    a replay then gets on at least as fast. The rounds follow how often one
    stock row runs out because of another, not the number of invoices.
    """
    numbered = number_within(lines.join(stock, _PAIR), _PAIR, ["RequestID"], "_rank")
    work = numbered.select(*_PAIR, "RequestID", "Quantity", "Available",
                           F.floor((F.col("_rank") - 1) / BLOCK_LINES).alias("_block"),
                           F.lit(0).cast("long").alias("Used"), F.lit(False).alias("_accepted"))
    decided: DataFrame | None = None
    open_before: list[int] = []
    while True:
        line = _with_bounds(work)
        verdict = line.groupBy("RequestID").agg(
            F.min(F.col("Used") + F.col("_open") + F.col("Quantity") <= F.col("Available")).alias("_fits"),
            F.max(F.col("Used") + F.col("Quantity") > F.col("Available")).alias("_full"))
        # one table per round: its decisions, and the lines the next one needs
        done = written_table(line.join(verdict, "RequestID").drop("_open"), "bounds")
        out = (done.filter("_fits or _full").select("RequestID", F.col("_fits").alias("Accepted")).distinct())
        decided = out if decided is None else decided.unionByName(out)
        work = done.filter("not _full").withColumnRenamed("_fits", "_accepted").drop("_full")
        left, largest = (done.filter("not _fits and not _full").select("StoreCode", "RequestID").distinct()
                         .groupBy("StoreCode").count()
                         .agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first())
        if largest <= enough or (len(open_before) > 1 and open_before[-2] - left <= enough):
            rest = _with_bounds(work).select(*_PAIR, "RequestID", "Quantity", "Used")
            return decided, rest, largest
        open_before.append(left)


def _replay(lines: DataFrame, stock: DataFrame, chunk: int) -> DataFrame:
    """Decide contested invoices. ``lines``: (StoreCode, RequestID, ISBN,
    Quantity); ``stock``: (StoreCode, ISBN, Available) of contested pairs.

    Invoices are replayed per store. Where a store has more than ``chunk``,
    bounds decide most of them first."""
    def most(count):
        return lines.groupBy("StoreCode").agg(count.alias("_n")).agg(F.max("_n")).first()[0] or 0

    # an invoice has a line at least: mostly, counting lines is enough
    if most(F.count(F.lit(1))) <= chunk or most(F.count_distinct("RequestID")) <= chunk:
        return _cogroup_replay(lines.withColumn("Used", F.lit(0).cast("long")), stock)
    out, lines, largest = decide_by_bounds(lines, stock, chunk)
    if largest <= chunk:
        return out.unionByName(_cogroup_replay(lines, stock))
    # Rounds: invoices of a store ranked by arrival, at most ``chunk`` per
    # round; stock is carried from round to round.
    reqs = lines.select("StoreCode", "RequestID").distinct()
    ranked = number_within(reqs, ["StoreCode"], ["RequestID"], "_rank").withColumn(
        "_round", F.floor((F.col("_rank") - 1) / chunk))
    lines_r = written_table(lines.join(ranked.select("RequestID", "_round"), "RequestID"), "rounds")
    for r in range((largest + chunk - 1) // chunk):
        part = lines_r.filter(F.col("_round") == r).drop("_round")
        dec = written_table(_cogroup_replay(part, stock), "decided")
        used = (part.join(dec.filter("Accepted"), "RequestID")
                .groupBy(*_PAIR).agg(F.sum("Quantity").alias("_used")))
        stock = (stock.join(used, _PAIR, "left")
                 .select(*_PAIR, (F.col("Available") - F.coalesce("_used", F.lit(0))).alias("Available"))
                 .checkpoint(eager=True))
        out = out.unionByName(dec)
    return out


# --- W1 --------------------------------------------------------------------------
def merge_lines(lines: DataFrame) -> DataFrame:
    """W4 merge: the same book twice in one request becomes one line at its
    first position. The sum stays a long: it may exceed any stock."""
    pos = F.col("LinePos") if "LinePos" in lines.columns else F.lit(1)
    bad = F.col("Quantity").isNull() | (F.col("Quantity") <= 0)
    merged = (lines.withColumn("LinePos", pos)
              .groupBy("RequestID", "ISBN")
              .agg(F.sum("Quantity").alias("_q"), F.max(bad.cast("int")).alias("_bad"),
                   F.min("LinePos").alias("LinePos")))
    # a missing or non-positive quantity on any addition makes the line invalid
    return merged.select("RequestID", "ISBN",
                         F.when(F.col("_bad") == 1, F.lit(None)).otherwise(F.col("_q"))
                         .alias("Quantity"), "LinePos")


class _Parts(dict):
    """Frames by name, each made when it is first asked for (some write)."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        super().__init__()
        self._makers = makers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._makers[name]()
        return self[name]


def classify_requests(t: Tables, headers: DataFrame, lines: DataFrame) -> Mapping[str, DataFrame]:
    """Steps 1-2 of the plan, all declarative. Returns frames:
    ``rejected`` (RequestID, Reason) certain rejects, ``contested_pairs``
    (StoreCode, ISBN, Demand, Available), ``certain_accepts`` (RequestID),
    ``contested_lines`` (StoreCode, RequestID, ISBN, Quantity),
    ``contested_stock`` (StoreCode, ISBN, Available), ``live_lines`` (lines
    of requests not certainly rejected, with the book's Price) and ``headers``
    of those requests. A frame that is not read costs nothing."""
    missing = F.lit(False)
    for c in HEADER_COLS:
        missing = missing | F.col(c).isNull()
    head = written_table(headers.select(*HEADER_COLS).withColumn("_head_ok", ~missing), "headers")
    # A book counts, and has its price, only where it is stocked: the stock rows
    # meet the catalogue, not the lines, which may name few books many times.
    book = t["Book"].select("ISBN", F.col("Price").alias("_price"), F.lit(True).alias("_book"))
    inv = (t["Inventory"].select("StoreCode", "ISBN", F.col("AvailableQuantity").alias("Available"))
           .join(book, "ISBN", "left"))
    # The batch is read by every later step and written once: the headers, and
    # the lines with their header's store (a line without a header is refused, not dropped; a
    # header without a line has a row of its own) and their stock row. A table
    # in spark.checkpoint.dir, of which each step reads the columns it needs and
    # the planner knows the size.
    hl = written_table(merge_lines(lines).withColumn("_line", F.lit(True))
                       .join(head.select("RequestID", "StoreCode", "_head_ok"), "RequestID", "full")
                       .join(inv, ["StoreCode", "ISBN"], "left"), "batch")
    line_reason = (F.when(~F.coalesce("_head_ok", F.lit(False)), F.lit(MISSING_HEADER))
                   .when(F.col("_line").isNull() | F.col("ISBN").isNull(), F.lit(NO_LINES))
                   .when(F.col("Quantity").isNull() | (F.col("Quantity") <= 0), F.lit(INVALID_QUANTITY))
                   .when(F.col("Available").isNull(), F.lit(NO_STOCK_ROW))
                   .when(F.col("_book").isNull(), F.lit(NOT_SELLABLE))
                   .when(F.col("Quantity") > F.col("Available"), F.lit(INSUFFICIENT_STOCK)))
    parts: _Parts

    def rejected() -> DataFrame:
        # only refused lines are compared: the reason that refuses a request at once
        told = hl.withColumn("_reason", line_reason).filter(F.col("_reason").isNotNull())
        return written_table(told.groupBy("RequestID").agg(F.min("_reason").alias("Reason")), "rejected")

    def live() -> DataFrame:
        return (hl.filter(F.col("RequestID").isNotNull()).join(parts["rejected"].select("RequestID"), "RequestID", "left_anti")
                .select("RequestID", "StoreCode", "ISBN", "Quantity", "LinePos", "Available", F.col("_price").alias("Price")))

    def contested_pairs() -> DataFrame:
        demand = (parts["live_lines"].groupBy("StoreCode", "ISBN")
                  .agg(F.sum("Quantity").alias("Demand"), F.first("Available").alias("Available")))
        return demand.filter(F.col("Demand") > F.col("Available"))

    def contested() -> DataFrame:
        # contested lines, with their starting stock, are read several times
        # (round sizing, stock, replay, certain accepts): written once
        pairs = parts["contested_pairs"].select("StoreCode", "ISBN")
        return written_table(parts["live_lines"].join(pairs, ["StoreCode", "ISBN"], "left_semi")
                             .select("StoreCode", "RequestID", "ISBN", "Quantity", "Available"), "contested")

    def sound() -> DataFrame:
        good = head.filter("_head_ok").join(parts["rejected"].select("RequestID"), "RequestID", "left_anti")
        return good.groupBy("RequestID").agg(*[F.first(c, ignorenulls=True).alias(c) for c in HEADER_COLS if c != "RequestID"])

    def certain() -> DataFrame:
        # no request with a contested line, found from the lines themselves
        refused = parts["rejected"].select("RequestID").unionByName(parts["_contested"].select("RequestID"))
        return head.filter("_head_ok").select("RequestID").join(refused, "RequestID", "left_anti").distinct()

    parts = _Parts({
        "rejected": rejected,
        "contested_pairs": contested_pairs,
        "certain_accepts": certain,
        "_contested": contested,
        "contested_lines": lambda: parts["_contested"].drop("Available"),
        "contested_stock": lambda: parts["_contested"].select("StoreCode", "ISBN", "Available").distinct(),
        "live_lines": live,
        "headers": sound,
    })
    return parts


def post_sales(t: Tables, headers: DataFrame, lines: DataFrame,
               chunk: int = DEFAULT_CHUNK) -> PostingResult:
    """Post a batch of sale requests.

    ``headers``: RequestID (arrival order), StoreCode, CustomerCode,
    EmployeeNationalCode, InvoiceDate. ``lines``: RequestID, ISBN, Quantity
    and optionally LinePos (position on the form) and UnitPrice (else the
    book's current price).
    """
    parts = classify_requests(t, headers, lines)
    # decisions are small (one row per contested invoice) and read twice
    decided = written_table(_replay(parts["contested_lines"], parts["contested_stock"], chunk), "decided")
    return PostingResult(t, lines, parts, decided)


def _unit_price(lines: DataFrame, acc_lines: DataFrame) -> DataFrame:
    if "UnitPrice" in lines.columns:
        pos = F.col("LinePos") if "LinePos" in lines.columns else F.lit(1)
        given = lines.groupBy("RequestID", "ISBN").agg(
            F.min(F.struct(pos.alias("p"), "UnitPrice"))["UnitPrice"].alias("UnitPrice"))
        return acc_lines.join(given, ["RequestID", "ISBN"])
    return acc_lines.withColumnRenamed("Price", "UnitPrice")      # the stocked book's, read with its stock row


def _apply_usage(inventory: DataFrame, change: DataFrame, sign: int) -> DataFrame:
    """Inventory with ``sign * _used`` added per (StoreCode, ISBN). The
    change frame is re-aliased: it usually derives from the inventory itself."""
    ch = change.select(F.col("StoreCode").alias("_cs"), F.col("ISBN").alias("_ci"), "_used")
    cols = [c for c in inventory.columns if c != "AvailableQuantity"]
    joined = inventory.join(ch, (inventory["StoreCode"] == ch["_cs"]) & (inventory["ISBN"] == ch["_ci"]), "left")
    new_qty = (inventory["AvailableQuantity"] + F.lit(sign) * F.coalesce(ch["_used"], F.lit(0))).cast("int")
    return joined.select(*[inventory[c] for c in cols], new_qty.alias("AvailableQuantity")).select(*inventory.columns)


# --- W4, W5 ---------------------------------------------------------------------
def build_invoice_lines(t: Tables, additions: DataFrame, chunk: int = sequential.DEFAULT_CHUNK) -> dict[str, DataFrame]:
    """Turn form additions (RequestID, Seq, StoreCode, ISBN, Quantity)
    into invoice lines. A book must be sellable in the store (stock row with
    quantity > 0); an addition that would take the line above that stock is
    refused on its own; repeated books merge at their first accepted
    position. Returns ``lines`` (RequestID, ISBN, Quantity, LinePos, Title,
    UnitPrice) and ``refused`` (RequestID, Seq, Reason)."""
    sellable = (t["Inventory"].filter(F.col("AvailableQuantity") > 0)
                .join(t["Book"].select("ISBN"), "ISBN", "left_semi")
                .select("StoreCode", "ISBN", F.col("AvailableQuantity").alias("Stock")))
    add = (additions.withColumn("_event", F.monotonically_increasing_id())
           .join(sellable, ["StoreCode", "ISBN"], "left")
           .checkpoint(eager=True))
    bad = (F.when(F.col("Quantity").isNull() | (F.col("Quantity") <= 0), F.lit(INVALID_QUANTITY))
           .when(F.col("Stock").isNull(), F.lit(NOT_SELLABLE)))
    add = add.withColumn("Reason", bad)
    ok = add.filter(F.col("Reason").isNull()).withColumn("_delta", -F.col("Quantity"))
    dec = bounded_walk(ok, ["RequestID", "ISBN"], "Seq", "_delta", "Stock", "_event", chunk)
    judged = ok.join(dec, "_event")
    accepted = judged.filter("Accepted")
    lines = (accepted.groupBy("RequestID", "ISBN")
             .agg(F.sum("Quantity").cast("int").alias("Quantity"), F.min("Seq").alias("LinePos"))
             .join(t["Book"].select("ISBN", "Title", F.col("Price").alias("UnitPrice")), "ISBN"))
    refused = (add.filter(F.col("Reason").isNotNull()).select("RequestID", "Seq", "Reason")
               .unionByName(judged.filter(~F.col("Accepted"))
                            .select("RequestID", "Seq", F.lit(INSUFFICIENT_STOCK).alias("Reason"))))
    return {"lines": lines, "refused": refused}


def invoice_totals(lines: DataFrame, key: str = "RequestID") -> DataFrame:
    """Line totals summed per invoice."""
    return lines.groupBy(key).agg(
        F.sum(F.col("Quantity") * F.col("UnitPrice")).cast(MONEY_SUM).alias("InvoiceTotal"),
        F.count(F.lit(1)).alias("Lines"))


# --- W6 --------------------------------------------------------------------------
def adjust_stock(t: Tables, adjustments: DataFrame, chunk: int = sequential.DEFAULT_CHUNK) -> dict[str, DataFrame]:
    """Stock adjustments (AdjustID arrival order, StoreCode, ISBN,
    Amount >= 1, Direction +1/-1). Refused when the row is missing or the
    result would be negative; a refused change changes nothing. Returns
    ``decisions`` (AdjustID, Accepted, Reason) and ``inventory``."""
    inv = t["Inventory"].select("StoreCode", "ISBN", F.col("AvailableQuantity").alias("Stock"))
    adj = adjustments.join(inv, ["StoreCode", "ISBN"], "left")
    valid = (F.col("Amount") >= 1) & F.col("Direction").isin(1, -1)
    reason = (F.when(~F.coalesce(valid, F.lit(False)), F.lit(INVALID_AMOUNT))
              .when(F.col("Stock").isNull(), F.lit(NO_STOCK_ROW)))
    # read by every step of the walk: written once, with its stock row
    adj = written_table(adj.withColumn("Reason", reason)
                        .withColumn("_delta", F.col("Amount").cast("long") * F.col("Direction")), "adjustments")
    ok = adj.filter(F.col("Reason").isNull())
    dec = bounded_walk(ok, ["StoreCode", "ISBN"], "AdjustID", "_delta", "Stock", "AdjustID", chunk)
    decisions = (adj.filter(F.col("Reason").isNotNull())
                 .select("AdjustID", F.lit(False).alias("Accepted"), "Reason")
                 .unionByName(dec.select(
                     "AdjustID", "Accepted",
                     F.when(F.col("Accepted"), F.lit(None).cast("string"))
                      .otherwise(F.lit(INSUFFICIENT_STOCK)).alias("Reason"))))
    change = (ok.join(dec, "AdjustID").filter("Accepted").groupBy("StoreCode", "ISBN").agg(F.sum("_delta").alias("_used")))
    return {"decisions": decisions, "inventory": _apply_usage(t["Inventory"], change, sign=1)}
