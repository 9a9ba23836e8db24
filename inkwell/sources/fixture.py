"""Test-data adapter: the twelve bookstore tables derived from the driver's
TPC-H-like parquet files (region nation customer supplier part orders
lineitem).

The mapping is fixed so that the same tables can be written as SQL for the
DuckDB oracle (``inkwell.plans.oracle``). Every table is a lazy DataFrame;
nothing runs until a report uses it, and Catalyst prunes what a report does
not reference.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.ordinal import number_in_blocks, with_ordinal
from inkwell.schemas import MONEY

#: RequestID of posting = block of orders * REQUEST_BLOCK + supplier: unique for
#: up to this many suppliers and 9.2e11 orders.
REQUEST_BLOCK = 1_000_000_000

#: Lines of requests that a task holds, on average.
TASK_ROWS = 250_000

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _nat(c: Column) -> Column:
    """National code: 10-digit zero-padded text."""
    return F.lpad(c.cast("string"), 10, "0")


def _isbn(c: Column) -> Column:
    """ISBN: 13-digit zero-padded text."""
    return F.lpad(c.cast("string"), 13, "0")


def _publisher_id(brand: Column) -> Column:
    return F.substring(brand, 7, 1 << 20).cast("int")


class FixtureTables(Mapping[str, DataFrame]):
    """Read-only mapping table name -> DataFrame, built on first access."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    # --- Mapping protocol -------------------------------------------------
    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            builder = getattr(self, f"_build_{name}", None)
            if builder is None:
                raise KeyError(name)
            self._cache[name] = builder()
        return self._cache[name]

    def __iter__(self) -> Iterator[str]:
        from inkwell.schemas import TABLES
        return iter(TABLES)

    def __len__(self) -> int:
        from inkwell.schemas import TABLES
        return len(TABLES)

    # --- driver tables ----------------------------------------------------
    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _store_count(self) -> Column:
        # scalar subquery, evaluated once by Spark; keeps the plan lazy
        return self.raw("supplier").select(F.count(F.lit(1))).scalar()

    # --- derived tables ---------------------------------------------------
    def _build_City(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        return (n.join(r, n.n_regionkey == r.r_regionkey)
                .select(n.n_nationkey.cast("int").alias("CityCode"),
                        n.n_name.alias("CityName"), r.r_name.alias("ProvinceName")))

    def _build_Store(self) -> DataFrame:
        s = self.raw("supplier")
        k = F.col("s_suppkey")
        return s.select(
            k.cast("int").alias("StoreCode"),
            F.col("s_nationkey").cast("int").alias("CityCode"),
            F.when(k % 4 == 0, F.lit(None).cast("string"))
             .when(k % 4 == 1, _nat((k + 1) * 10))
             .otherwise(_nat(k * 10)).alias("ManagerNationalCode"),
            F.concat(F.lit("021-"), k.cast("string")).alias("Phone"),
            F.col("s_name").alias("Address"),
        )

    def _build_Employee(self) -> DataFrame:
        s = self.raw("supplier").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        sk, k = F.col("s_suppkey"), F.col("k")
        return s.select(
            _nat(sk * 10 + k).alias("NationalCode"),
            F.concat(F.lit("Employee "), sk.cast("string"), F.lit("-"), k.cast("string")).alias("FullName"),
            F.when(k == 2, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("0912-"), sk.cast("string"))).alias("Phone"),
            F.col("s_name").alias("Address"),
            F.when(k % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("Gender"),
            sk.cast("int").alias("StoreCode"),
        )

    def _build_Customer(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        return c.select(
            k.cast("int").alias("CustomerCode"),
            F.col("c_name").alias("FullName"),
            F.when(k % 7 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("0935-"), k.cast("string"))).alias("Phone"),
            F.col("c_mktsegment").alias("Address"),
            F.col("c_acctbal").cast(MONEY).alias("DebtAmount"),
        )

    def _build_Publisher(self) -> DataFrame:
        return (self.raw("part")
                .select(_publisher_id(F.col("p_brand")).alias("PublisherID"),
                        F.col("p_brand").alias("PublisherName"))
                .distinct())

    def _build_Book(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            _isbn(F.col("p_partkey")).alias("ISBN"),
            F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("Title"),
            F.col("p_type").alias("Subject"),
            F.col("p_retailprice").cast(MONEY).alias("Price"),
            _publisher_id(F.col("p_brand")).alias("PublisherID"),
            F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("short"))
             .otherwise((F.col("p_size") + 1350).cast("short")).alias("PublicationYear"),
        )

    def _book_writer(self) -> DataFrame:
        """(ISBN, AuthorName): two invented authors per book, from the first
        and second word of the part name; every 50th book has none."""
        p = self.raw("part").filter(F.col("p_partkey") % 50 != 0)
        names = F.array(*[
            F.concat(F.split_part(F.col("p_name"), F.lit(" "), F.lit(w)), F.lit(" "), F.col("p_brand"))
            for w in (1, 2)
        ])
        return (p.select(_isbn(F.col("p_partkey")).alias("ISBN"), F.explode(names).alias("AuthorName"))
                .distinct())

    def _build_Author(self) -> DataFrame:
        names = self._book_writer().select("AuthorName").distinct()
        return (with_ordinal(names, ["AuthorName"], "AuthorID")
                .select(F.col("AuthorID").cast("int"), "AuthorName"))

    def _build_BookAuthor(self) -> DataFrame:
        return self._book_writer().join(self["Author"], "AuthorName").select("ISBN", "AuthorID")

    def _build_Inventory(self) -> DataFrame:
        pairs = self.raw("lineitem").select("l_suppkey", "l_partkey").distinct()
        s, p = F.col("l_suppkey"), F.col("l_partkey")
        return pairs.select(
            s.cast("int").alias("StoreCode"),
            _isbn(p).alias("ISBN"),
            ((s * 7 + p * 13) % 40).cast("int").alias("AvailableQuantity"),
            ((s * 3 + p * 5) % 15).cast("int").alias("MinimumQuantity"),
            F.when((s + p) % 3 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("shelf "), (p % 20).cast("string"))).alias("Description"),
        )

    def _build_Sale(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        store = k % self._store_count()
        return o.select(
            k.alias("InvoiceNumber"),
            F.col("o_orderdate").cast("date").alias("InvoiceDate"),
            F.col("o_custkey").cast("int").alias("CustomerCode"),
            store.cast("int").alias("StoreCode"),
            _nat(store * 10 + k % 3).alias("EmployeeNationalCode"),
        )

    def _build_SaleItem(self) -> DataFrame:
        return self._sale_items(self.raw("lineitem"))

    def sale_items_of(self, invoices: DataFrame) -> DataFrame:
        """The rows of SaleItem of the ``invoices`` (InvoiceNumber)."""
        keys = invoices.select(F.col("InvoiceNumber").alias("l_orderkey"))
        return self._sale_items(self.raw("lineitem").join(keys, "l_orderkey", "left_semi"))

    @staticmethod
    def _sale_items(lines: DataFrame) -> DataFrame:
        li = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        numbered = number_in_blocks(
            li, ["l_orderkey"], "l_linenumber",
            ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "LineNumber")
        return numbered.select(
            F.col("l_orderkey").alias("InvoiceNumber"),
            "LineNumber",
            _isbn(F.col("l_partkey")).alias("ISBN"),
            F.col("l_quantity").cast("int").alias("Quantity"),
            F.col("l_extendedprice").cast(MONEY).alias("UnitPrice"),
        )

    def _build_PublisherPurchase(self) -> DataFrame:
        price = F.col("l_extendedprice").cast(MONEY)
        # Pre-aggregate lineitem to (part, supplier) before the join with part,
        # so the join and the final shuffle carry one row per pair, not per line.
        per_pair = (self.raw("lineitem")
                    .groupBy("l_partkey", "l_suppkey")
                    .agg(F.min("l_shipdate").alias("first_ship"),
                         F.sum(price).alias("total"),
                         F.sum(F.when(F.col("l_returnflag") != "R", price).otherwise(F.lit(0))).alias("paid")))
        part = self.raw("part").select("p_partkey", "p_brand")
        grouped = (per_pair.join(part, per_pair.l_partkey == part.p_partkey)
                   .groupBy("p_brand", "l_suppkey")
                   .agg(F.min("first_ship").cast("date").alias("PurchaseDate"),
                        F.sum("total").cast(MONEY).alias("TotalAmount"),
                        F.sum("paid").cast(MONEY).alias("PaidAmount")))
        numbered = with_ordinal(grouped, ["p_brand", "l_suppkey"], "PurchaseID")
        return numbered.select(
            F.col("PurchaseID").cast("int"),
            _publisher_id(F.col("p_brand")).alias("PublisherID"),
            F.col("l_suppkey").cast("int").alias("StoreCode"),
            "PurchaseDate", "TotalAmount", "PaidAmount",
        )

    # --- sale requests for posting (W1) ----------------------------------
    def post_stock(self) -> DataFrame:
        """A dense stock table for posting: every store x books 0..18, with
        10..49 copies each. Book 19 has no stock row on purpose."""
        s = self.raw("supplier").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(18))))
        sk, p = F.col("s_suppkey"), F.col("p").cast("long")
        return s.select(
            sk.cast("int").alias("StoreCode"), _isbn(p).alias("ISBN"),
            (F.lit(10) + (sk * 7 + p * 13) % 40).cast("int").alias("AvailableQuantity"),
            F.lit(0).alias("MinimumQuantity"), F.lit(None).cast("string").alias("Description"))

    def _post_source(self) -> DataFrame:
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        li = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
        return (li.join(o, li.l_orderkey == o.o_orderkey)
                .withColumn("RequestID", F.floor(F.col("l_orderkey") / 100).cast("long") * REQUEST_BLOCK
                            + F.col("l_suppkey")))

    def post_lines(self) -> DataFrame:
        """(RequestID, ISBN, Quantity, LinePos): request = 100 consecutive
        orders of one supplier; books 0..19."""
        # by request from the start: its lines are few, and merging them and
        # finding their header then need no other shuffle; over as many tasks
        # as the lines need (counted from the files' footers)
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.raw("lineitem").count() // TASK_ROWS)
        src = (self._post_source().select("RequestID", (F.col("l_partkey") % 20).alias("b"), "l_quantity")
               .repartition(tasks, "RequestID"))
        return (src.groupBy("RequestID", "b")
                .agg(F.sum("l_quantity").alias("q"))
                .select("RequestID", _isbn(F.col("b")).alias("ISBN"),
                        (F.floor(F.col("q") / 10) + 1).cast("int").alias("Quantity"),
                        (F.col("b") + 1).cast("int").alias("LinePos")))

    def post_headers(self) -> DataFrame:
        """(RequestID, StoreCode, CustomerCode, EmployeeNationalCode, InvoiceDate)."""
        return (self._post_source().groupBy("RequestID", "l_suppkey")
                .agg(F.min("o_custkey").alias("c"), F.min("o_orderdate").alias("d"))
                .select("RequestID", F.col("l_suppkey").cast("int").alias("StoreCode"),
                        F.col("c").cast("int").alias("CustomerCode"),
                        _nat(F.col("l_suppkey") * 10).alias("EmployeeNationalCode"),
                        F.col("d").cast("date").alias("InvoiceDate")))

    def posting_tables(self) -> dict[str, DataFrame]:
        """The tables as seen by posting: ``Inventory`` is the dense stock."""
        out = {name: self[name] for name in ("Book", "Sale")}
        out["Inventory"] = self.post_stock()
        return out


def fixture_tables(spark: SparkSession, sf_dir: str) -> FixtureTables:
    return FixtureTables(spark, sf_dir)
