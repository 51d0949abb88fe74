"""A property graph and reference tables derived from the star-schema tables.

Every definition exists twice: as DataFrame code here and as SQL text in
``star_sql``, which a second engine can run on the same files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}::"), F.col(key).cast("string"))


def _seq(phase: int, file_key: str, sym: str, line: str | None = None, is_create: int = 0, order: str | None = None) -> Column:
    return F.struct(
        F.lit(phase).alias("phase"),
        F.lit(file_key).alias("file_key"),
        F.col(sym).cast("long").alias("sym_ord"),
        (F.col(line) if line else F.lit(0)).cast("long").alias("line"),
        F.lit(is_create).alias("is_create"),
        (F.col(order) if order else F.lit(0)).cast("long").alias("ord"),
    ).alias("seq")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(name, prefix, key, kind, label, qualified, file, line, signature):
        return table(spark, sf_dir, name).select(
            _id(prefix, key).alias("id"),
            kind.alias("kind"),
            label.alias("name"),
            qualified.alias("qualified"),
            file.alias("file"),
            F.lit(name).alias("language"),
            line.cast("int").alias("start_line"),
            (line + 1).cast("int").alias("end_line"),
            signature.alias("signature"),
            F.lit("").alias("doc_comment"),
        )

    none, zero = F.lit(""), F.lit(0)
    order_name = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    order_kind = F.when(F.col("o_orderpriority") == "1-URGENT", "endpoint").otherwise("method")
    parts = [
        rows("region", "region", "r_regionkey", F.lit("file"), F.col("r_name"), F.col("r_name"), F.col("r_name"), zero, none),
        rows("nation", "nation", "n_nationkey", F.lit("interface"), F.col("n_name"), none, F.lit("nation"), zero, none),
        rows("customer", "customer", "c_custkey", F.lit("class"), F.col("c_name"), none, F.col("c_mktsegment"), F.col("c_nationkey") + 1, none),
        rows("supplier", "supplier", "s_suppkey", F.lit("class"), F.col("s_name"), none, F.lit("supplier"), F.col("s_nationkey") + 1, none),
        rows("part", "part", "p_partkey", F.lit("type"), F.col("p_name"), F.concat("p_brand", F.lit("."), "p_name"), F.col("p_brand"), F.col("p_size"), F.col("p_type")),
        rows("orders", "order", "o_orderkey", order_kind, order_name, order_name, F.concat(F.lit("orders/"), "o_orderstatus"), F.col("o_custkey") + 1, none),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, edge_tables(spark, sf_dir))


def edge_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The edges by the tables they come from: joined one by one, only what a join finds gets its other columns."""

    def rows(name, start, end, kind, seq):
        return table(spark, sf_dir, name).select(
            _id(*start).alias("from_id"), _id(*end).alias("to_id"), F.lit(kind).alias("kind"), seq
        )

    return [
        rows("nation", ("region", "n_regionkey"), ("nation", "n_nationkey"), "defines", _seq(0, "region", "n_nationkey")),
        rows("customer", ("customer", "c_custkey"), ("nation", "c_nationkey"), "implements", _seq(2, "customer", "c_custkey")),
        rows("supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "implements", _seq(2, "supplier", "s_suppkey")),
        rows("orders", ("order", "o_orderkey"), ("customer", "o_custkey"), "calls", _seq(3, "order", "o_orderkey")),
        rows("lineitem", ("order", "l_orderkey"), ("part", "l_partkey"), "calls", _seq(3, "order", "l_orderkey", "l_linenumber", 0, "l_partkey")),
        rows("lineitem", ("part", "l_partkey"), ("supplier", "l_suppkey"), "instantiates", _seq(3, "part", "l_partkey", "l_orderkey", 1, "l_linenumber")),
    ]


def queue_edge_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """A market's suppliers in an order that is not that of their ids, what they sold, and the brands of that.

    The kind of an edge changes from row to row, so parts and brands are met over several kinds.
    """
    kind = lambda c: F.element_at(F.array(*[F.lit(k) for k in ("calls", "imports", "references")]), (F.col(c) % 3 + 1).cast("int"))
    mixed = lambda c: F.col(c) * 7919 % 100003

    def rows(name: str, start: Column, end: Column, kind: Column, ord_: Column) -> DataFrame:
        seq = F.struct(F.lit(3).alias("phase"), F.lit(name).alias("file_key"), F.lit(0).cast("long").alias("sym_ord"), F.lit(0).cast("long").alias("line"), F.lit(0).alias("is_create"), ord_.cast("long").alias("ord"))
        return table(spark, sf_dir, name).select(start.alias("from_id"), end.alias("to_id"), kind.alias("kind"), seq.alias("seq"))

    return [
        rows("supplier", F.lit("market"), _id("supplier", "s_suppkey"), F.lit("calls"), mixed("s_suppkey")),
        rows("lineitem", _id("supplier", "l_suppkey"), _id("part", "l_partkey"), kind("l_linenumber"), mixed("l_orderkey") * 10 + F.col("l_linenumber")),
        rows("part", _id("part", "p_partkey"), F.concat(F.lit("brand::"), "p_brand"), kind("p_size"), F.col("p_partkey")),
    ]


def queue_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, queue_edge_tables(spark, sf_dir))


_KIND = "(['calls', 'imports', 'references'])[{} % 3 + 1]"
QUEUE_SQL = f"""WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey * 7919 % 100003, s_suppkey) AS r FROM supplier),
  p AS (SELECT l_partkey, min(struct_pack(r := r, o := l_orderkey * 7919 % 100003 * 10 + l_linenumber, k := {_KIND.format('l_linenumber')})) AS f
    FROM lineitem JOIN s ON s_suppkey = l_suppkey GROUP BY l_partkey),
  b AS (SELECT p_brand, arg_min({_KIND.format('p_size')}, struct_pack(r := f.r, o := f.o, i := 'part::' || p_partkey)) AS via FROM part JOIN p ON p_partkey = l_partkey GROUP BY p_brand)
  SELECT 'supplier::' || s_suppkey AS id, 1 AS distance, 'calls' AS via FROM s
  UNION ALL SELECT 'part::' || l_partkey, 2, f.k FROM p UNION ALL SELECT 'brand::' || p_brand, 3, via FROM b"""


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph: users call event types; low-valued events refer back to their user."""
    events = table(spark, sf_dir, "events")
    user = _id("user", "user_id")
    kind = F.concat(F.lit("type::"), "event_type")
    back = F.col("value") < 10
    return events.select(
        F.when(back, kind).otherwise(user).alias("from_id"),
        F.when(back, user).otherwise(kind).alias("to_id"),
        F.when(back, "references").otherwise("calls").alias("kind"),
        _seq(3, "event", "event_id"),
    )


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the users: the event types stay dangling ids."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        _id("user", "user_id").alias("id"),
        F.lit("function").alias("kind"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"),
        F.lit("").alias("qualified"),
        F.lit("events").alias("file"),
        F.lit("events").alias("language"),
        F.lit(0).alias("start_line"),
        F.lit(0).alias("end_line"),
        F.lit("").alias("signature"),
        F.lit("").alias("doc_comment"),
    )


# --- reference resolution over the tables ------------------------------------------------


def _symbol_id(file: str | Column, qualified: Column) -> Column:
    return F.concat(F.lit("symbol::"), F.lit(file) if isinstance(file, str) else file, F.lit("::"), qualified)


def name_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name index: part names shared by many brands, unique customer names, brand methods."""
    part = table(spark, sf_dir, "part")
    by_name = part.select(
        F.col("p_name").alias("name"),
        _symbol_id(F.col("p_brand"), F.col("p_name")).alias("id"),
        F.col("p_brand").alias("file_key"),
        F.col("p_partkey").alias("sym_ord"),
    )
    methods = part.select(
        F.concat("p_brand", F.lit("."), F.col("p_size").cast("string")).alias("name"),
        _symbol_id(F.col("p_type"), F.concat("p_brand", F.lit("."), F.col("p_size").cast("string"))).alias("id"),
        F.col("p_type").alias("file_key"),
        F.col("p_partkey").alias("sym_ord"),
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"),
        _symbol_id("customers", F.col("c_name")).alias("id"),
        F.lit("customers").alias("file_key"),
        F.col("c_custkey").alias("sym_ord"),
    )
    return by_name.unionByName(methods).unionByName(customers)


def bare_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part symbols naming other parts (ambiguous) and orders naming customers (unique)."""
    part = table(spark, sf_dir, "part")
    user = part.select(F.col("p_partkey").alias("l_partkey"), _symbol_id(F.col("p_brand"), F.col("p_name")).alias("from_id"))
    named = part.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("name"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    by_part = items.join(user, "l_partkey").join(named, "l_suppkey").select("from_id", "name")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    by_order = table(spark, sf_dir, "orders").join(customers, "o_custkey").select(
        _symbol_id("orders", F.col("o_orderkey").cast("string")).alias("from_id"), "name"
    )
    return by_part.unionByName(by_order)


def type_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types named by part name and size: mostly unique, some declared twice."""
    key = F.concat("p_name", F.lit("/"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(key.alias("name"), _symbol_id(F.col("p_brand"), key).alias("id"))


def create_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.concat("p_name", F.lit("/"), F.col("p_size").cast("string"))
    user = part.select(F.col("p_partkey").alias("l_suppkey"), _symbol_id(F.col("p_brand"), key).alias("from_id"))
    named = part.select(F.col("p_partkey").alias("l_partkey"), key.alias("name"))
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return items.join(user, "l_suppkey").join(named, "l_partkey").select("from_id", "name")


def variable_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module variables: one per supplier (unique) and one per supplier's nation (ambiguous)."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_name", "s_nationkey")
    brand = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = supplier.join(brand, "p_partkey")
    unique = rows.select(F.col("s_name").alias("name"), F.col("p_brand").alias("type_name"))
    shared = rows.select(
        F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("name"), F.col("p_brand").alias("type_name")
    )
    return unique.unionByName(shared)


def variable_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item calls method <line number> through its supplier's variable and its nation's."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    items = table(spark, sf_dir, "lineitem").join(supplier, "l_suppkey")
    receiver = F.explode(F.array(F.col("s_name"), F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string"))))
    return items.select(
        _symbol_id("orders", F.col("l_orderkey").cast("string")).alias("from_id"),
        F.col("l_linenumber").cast("string").alias("name"),
        receiver.alias("receiver_var"),
    )


def typed_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(types, nodes, implements, calls): nations are interfaces, brands classes.

    Suppliers make their part's brand implement their nation.  An order calls
    method <part size> on its customer's nation, and on the brand of the part
    numbered like the customer; the caller is that part's own method, so that
    callers meet themselves among the candidates.
    """
    part = table(spark, sf_dir, "part")
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    brand_id = _symbol_id("brands", F.col("p_brand"))
    nation_id = _symbol_id("nations", F.col("n_name"))
    brands = part.select("p_brand").distinct()
    types = nation.select(F.col("n_name").alias("name"), nation_id.alias("id")).unionByName(
        brands.select(F.col("p_brand").alias("name"), brand_id.alias("id"))
    )
    kinds = nation.select(nation_id.alias("id"), F.lit("interface").alias("kind"), F.col("n_name").alias("name")).unionByName(
        brands.select(brand_id.alias("id"), F.lit("class").alias("kind"), F.col("p_brand").alias("name"))
    )
    implements = (
        supplier.join(part, F.col("s_suppkey") == F.col("p_partkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(brand_id.alias("from_id"), nation_id.alias("to_id"))
    )
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    method = F.col("p_size").cast("string")
    calls = (
        table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(part, F.col("o_custkey") == F.col("p_partkey"))
        .select(
            _symbol_id(F.col("p_type"), F.concat("p_brand", F.lit("."), method)).alias("from_id"),
            method.alias("name"),
            F.explode(F.array("n_name", "p_brand")).alias("receiver_type"),
        )
    )
    return types, kinds, implements, calls


def import_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(imports, files): one file per part in its brand's folder.

    Every line item makes its part's file import its supplier's namesake twice:
    from the same folder, which only works within a brand, and through the
    brand's folder.
    """
    part = table(spark, sf_dir, "part")
    path = F.concat("p_brand", F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".ts"))
    files = part.select(F.concat(F.lit("file::"), path).alias("id"), path.alias("path"), path.alias("file_key"))
    user = part.select(F.col("p_partkey").alias("l_partkey"), path.alias("path"))
    used = part.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_brand").alias("used_brand"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    items = table(spark, sf_dir, "lineitem").select(*keys).join(user, "l_partkey").join(used, "l_suppkey")
    supplier = F.col("l_suppkey").cast("string")
    names = F.array(F.concat(F.lit("./p"), supplier), F.concat(F.lit("../"), "used_brand", F.lit("/./p"), supplier))
    return items.select("path", F.explode(names).alias("name"), *keys), files


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order does, as references: calls of parts and creations of suppliers by line number."""
    items = table(spark, sf_dir, "lineitem")
    order = _id("order", "l_orderkey").alias("from_id")
    calls = items.select(order, _id("part", "l_partkey").alias("name"), _seq(3, "order", "l_orderkey", "l_linenumber", 0, "l_partkey"))
    creates = items.select(order, _id("supplier", "l_suppkey").alias("name"), _seq(3, "order", "l_orderkey", "l_linenumber", 1, "l_suppkey"))
    return calls.unionByName(creates)
