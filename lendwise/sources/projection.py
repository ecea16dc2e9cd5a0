"""Stand-in library tables built from the driver's TPC-H-shaped test tables.

The driver data holds no library data, so the registered queries run on this projection. It only supplies
rows in the library schema; none of the library's operators rely on how the rows were made. The same
projection is written a second time, independently, as DuckDB SQL in ``lendwise.oracle``.

Fact-sized sources (orders, lineitem, part, customer, events) map one-to-one or through key joins, so the
projected tables grow with the input. A handful of tiny dimension tables are fixed lists (fine reasons,
providers, licenses, resource types, partner libraries, e-resources, terms).
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendwise.sources.tables import Tables, conform, from_rows, spread, tasks_for

# Reference date of every registered query: one day after the last order date of the test data.
AS_OF = dt.date(2001, 8, 2)
RETURN_CUTOFF = "2001-08-01"
NEVER_BORROWS = 1_000_000_000  # patron ids of suppliers start here


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pad13(c):
    return F.lpad(c.cast("string"), 13, "0")


def _ts(c):
    # zone-less parquet timestamps arrive as timestamp_ntz, which is what the library works in (wall clock)
    return c.cast("timestamp_ntz")


def _to_second(c):
    # truncation through zone-less text: no session time zone is involved
    fmt = "yyyy-MM-dd HH:mm:ss"
    return F.to_timestamp_ntz(F.date_format(_ts(c), fmt), F.lit(fmt))


def _dims(spark: SparkSession) -> dict[str, DataFrame]:
    """Small fixed dimension tables (fixed values)."""
    terms = []
    for y in range(1995, 2002):
        for k, season in enumerate(("Spring", "Summer", "Fall")):
            terms.append(((y - 1995) * 3 + k + 1, season, y,
                          dt.date(y, 1 + 4 * k, 10), dt.date(y, 4 + 4 * k, 20)))
    reasons = [(1, "LATE", "Returned after the due date"), (2, "LOST", "Item lost"),
               (3, "DAMAGED", "Item damaged"), (4, "OTHER", None)]
    providers = [(i + 1, f"Provider {i + 1}", None if i == 4 else f"p{i + 1}@example.com", i) for i in range(5)]
    licenses = [(i + 1, i + 1, dt.date(2024, 1, 1), dt.date(2026, 12, 31), 5 * (i + 1)) for i in range(5)]
    rtypes = [(1, "Ebook"), (2, "Ejournal"), (3, "Database")]
    partners = [(i, f"Partner {i}", i) for i in range(1, 7)]
    eres = [(i + 1, f"E-Resource {i + 1}", i % 3 + 1, i % 5 + 1) for i in range(20)]
    return {
        "term": from_rows(spark, "term", terms),
        "finereason": from_rows(spark, "finereason", reasons),
        "provider": from_rows(spark, "provider", providers),
        "license": from_rows(spark, "license", licenses),
        "resourcetype": from_rows(spark, "resourcetype", rtypes),
        "partnerlibrary": from_rows(spark, "partnerlibrary", partners),
        "eresource": from_rows(spark, "eresource", eres),
    }


def project(spark: SparkSession, sf_dir: str) -> Tables:
    """Library tables derived from ``<sf_dir>/*.parquet`` (lazy; only the number of line items is looked up, from the files'
    footers)."""
    nation, region = _raw(spark, sf_dir, "nation"), _raw(spark, sf_dir, "region")
    part = _raw(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    customer = _raw(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    supplier = _raw(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    orders = _raw(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    lineitem = _raw(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    events = _raw(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")

    tasks = tasks_for(spark, lineitem.count())
    t = _dims(spark)

    k = F.col("n_nationkey")
    t["address"] = conform(nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        k.alias("address_id"), F.concat(k.cast("string"), F.lit(" Main St")).alias("street"),
        F.col("n_name").alias("city"),
        F.when(k % 5 != 0, F.concat(F.lit("S"), k.cast("string"))).alias("state"),
        F.lpad(k.cast("string"), 5, "0").alias("postal_code"), F.col("r_name").alias("country")), "address")
    t["branch"] = conform(nation.select(
        k.alias("branch_id"), F.concat(F.lit("Branch "), F.col("n_name")).alias("name"),
        k.alias("address_id")), "branch")

    brand_no = F.substring_index("p_brand", "#", -1).cast("bigint")
    t["publisher"] = conform(part.select("p_brand").distinct().select(
        brand_no.alias("publisher_id"), F.col("p_brand").alias("name"),
        (brand_no % 25).alias("address_id")), "publisher")
    t["author"] = conform(supplier.select(
        F.col("s_suppkey").alias("author_id"), F.substring_index("s_name", "#", 1).alias("first_name"),
        F.substring_index("s_name", "#", -1).alias("last_name")), "author")

    words = part.select(F.col("p_partkey"), F.explode(F.split("p_name", " ")).alias("word")).distinct()
    # distinct words form a bounded vocabulary; numbering it needs one ordered pass over that small set
    vocab = words.select("word").distinct()
    t["subject"] = conform(vocab.select(
        F.row_number().over(Window.orderBy("word")).alias("subject_id"), F.col("word").alias("name")), "subject")
    t["booksubject"] = conform(words.join(t["subject"], words.word == t["subject"].name).select(
        _pad13(F.col("p_partkey")).alias("isbn"), "subject_id"), "booksubject")

    t["book"] = conform(part.select(
        _pad13(F.col("p_partkey")).alias("isbn"), F.col("p_name").alias("title"),
        brand_no.alias("publisher_id"), (F.lit(1990) + F.col("p_size") % 30).alias("pub_year")), "book")
    # dealt by book before they are made distinct: no scan task holds its rows in a hash map, and a book's authors arrive together
    t["bookauthor"] = conform(spread(lineitem.select(
        _pad13(F.col("l_partkey")).alias("isbn"), F.col("l_suppkey").alias("author_id")), "isbn", tasks=tasks).distinct(), "bookauthor")

    copies = part.select("p_partkey", "p_size",
                         F.explode(F.sequence(F.lit(0), F.col("p_size") % 4)).alias("k"))
    copy_id = F.col("p_partkey") * 4 + F.col("k")
    t["copy"] = conform(copies.select(
        copy_id.alias("copy_id"), _pad13(F.col("p_partkey")).alias("isbn"),
        ((F.col("p_partkey") + F.col("k")) % 25).alias("branch_id"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_partkey") % 21 + 1).alias("checkin_term_id"),
        F.concat(F.lit("BC"), copy_id.cast("string")).alias("barcode")), "copy")

    ck = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    borrowers = conform(customer.select(
        ck.alias("patron_id"), F.substring_index("c_name", "#", 1).alias("first_name"),
        F.substring_index("c_name", "#", -1).alias("last_name"),
        F.when(ck % 11 != 0, F.concat(F.lit("c"), ck.cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(seg == "HOUSEHOLD", "Student").when(seg == "BUILDING", "Faculty")
         .when(seg == "AUTOMOBILE", "Staff").when(seg == "FURNITURE", "Alumni").otherwise("Guest")
         .alias("patron_type"),
        F.when(ck % 13 != 0, F.col("c_nationkey")).alias("address_id"),
        ((ck % 500).cast("decimal(10,0)") * F.lit(Decimal("0.01"))).alias("balance")), "patron")
    # suppliers place no orders: they are the patrons that never borrow
    sk = F.col("s_suppkey")
    t["patron"] = borrowers.unionAll(conform(supplier.select(
        (sk + NEVER_BORROWS).alias("patron_id"), F.substring_index("s_name", "#", 1).alias("first_name"),
        F.substring_index("s_name", "#", -1).alias("last_name"),
        F.concat(F.lit("s"), sk.cast("string"), F.lit("@example.com")).alias("email"), F.lit("Staff").alias("patron_type"),
        F.col("s_nationkey").alias("address_id"), F.lit(0).alias("balance")), "patron"))

    # one loan per distinct (order, part): the line items are the fact table, every order takes part
    # dealt by order before they are made distinct: the join with the orders needs no second shuffle of the lines
    lines = spread(lineitem.select("l_orderkey", "l_partkey"), "l_orderkey", tasks=tasks).distinct()
    src = (orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
           .join(part.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")))
    ok = F.col("o_orderkey")
    loan_id = ok * 1_000_000_000 + F.col("l_partkey")
    odate = _ts(F.col("o_orderdate"))
    ret = odate + F.make_dt_interval(days=(loan_id % 30 + 1).cast("int"))
    src = src.select(
        loan_id.alias("loan_id"), (F.col("l_partkey") * 4 + ok % (F.col("p_size") % 4 + 1)).alias("copy_id"),
        F.col("o_custkey").alias("patron_id"),
        (odate + F.make_dt_interval(hours=(ok % 24).cast("int"))).alias("loan_ts"),
        (odate + F.make_dt_interval(F.lit(14), F.lit(23), F.lit(59), F.lit(59))).alias("due_ts"),
        F.when((F.col("o_orderstatus") != "O") & (ret <= F.lit(RETURN_CUTOFF).cast("timestamp_ntz")),
               ret + F.make_dt_interval(hours=F.lit(10))).alias("return_ts"),
        "o_orderpriority", "o_totalprice")
    t["loan"] = conform(src, "loan")

    pr = F.col("o_orderpriority")
    t["fine"] = conform(src.filter("return_ts > due_ts").select(  # a late return is fined
        F.col("loan_id").alias("fine_id"), "loan_id", "patron_id",
        F.when(pr.startswith("1"), 2).when(pr.startswith("5"), 3).otherwise(1).alias("reason_id"),
        (F.floor(F.col("o_totalprice") / 100).cast("decimal(18,0)") * F.lit(Decimal("0.01"))).alias("amount"),
        F.element_at(F.array(*[F.lit(s) for s in ("Paid", "Unpaid", "Payment Pending", "Waived")]),
                     (F.col("loan_id") % 4 + 1).cast("int")).alias("status"),
        F.col("due_ts").alias("created_at")), "fine")

    eid = F.col("event_id")
    et = F.col("event_type")
    # events use the whole range of books; every second one the first tenth of it, so some books are in demand
    span = part.agg(F.min("p_partkey").alias("part_min"), F.count(F.lit(1)).alias("part_n")).crossJoin(
        supplier.agg(F.min("s_suppkey").alias("supp_min"), F.count(F.lit(1)).alias("supp_n")))  # one row
    book_at = F.expr("part_min + event_id % CASE WHEN event_id % 2 = 0 THEN greatest(part_n div 10, 1) ELSE part_n END")
    who = F.expr(f"CASE WHEN event_id % 10 = 7 THEN {NEVER_BORROWS} + supp_min + event_id % supp_n ELSE user_id END")
    used = events.crossJoin(span).select("event_id", "ts", "event_type", who.alias("patron_id"), _pad13(book_at).alias("isbn"))
    t["reservation"] = conform(used.filter(et != "signup").select(
        eid.alias("reservation_id"), "patron_id", "isbn",
        (eid % 25).alias("branch_id"), _to_second(F.col("ts")).alias("created_at"),
        F.when(et == "view", "Active").when(et == "click", "Waiting").when(et == "purchase", "Fulfilled")
         .otherwise("Cancelled").alias("status")), "reservation")

    start = _to_second(F.col("ts"))
    t["accesssession"] = conform(events.select(
        eid.alias("session_id"), F.col("user_id").alias("patron_id"), (eid % 19 + 1).alias("resource_id"),
        start.alias("start_time"),
        F.when(eid % 8 != 0, start + F.make_dt_interval(mins=(eid % 90).cast("int"))).alias("end_time")),
        "accesssession")

    t["illrequest"] = conform(used.filter(et == "signup").select(
        eid.alias("request_id"), "patron_id", (eid % 6 + 1).alias("partner_id"), "isbn",
        F.element_at(F.array(*[F.lit(x) for x in ("Requested", "Shipped", "Received", "Completed", "Cancelled")]),
                     (eid % 5 + 1).cast("int")).alias("status"),
        _to_second(F.col("ts")).alias("requested_at")), "illrequest")

    return Tables(t, tasks)
