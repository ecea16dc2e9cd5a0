"""The ten named views (V-01 ... V-10) as DataFrame functions.

Fact tables are aggregated on their own key before any dimension join (the views' GROUP BY over a joined
fan-out is replaced by per-key pre-aggregation, which gives the same rows without materializing the product).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwise.functions import as_timestamp, full_name, ordered_distinct_concat
from lendwise.sources.tables import Tables


def book_authors(t: Tables, order_by_first: bool = True) -> DataFrame:
    """isbn -> 'First Last, ...' ordered by (last, first) (or by last only), distinct names."""
    a = t.bookauthor.join(t.author, "author_id")
    keys = [F.col("last_name"), F.col("first_name")] if order_by_first else [F.col("last_name")]
    return a.groupBy("isbn").agg(
        ordered_distinct_concat(full_name(), order_by=keys).alias("authors"))


def book_subjects(t: Tables) -> DataFrame:
    """isbn -> 'subject, ...' ordered by name, distinct."""
    s = t.booksubject.join(t.subject, "subject_id")
    return s.groupBy("isbn").agg(ordered_distinct_concat(F.col("name")).alias("subjects"))


def v01_book_details(t: Tables) -> DataFrame:
    """Per book: publisher name, distinct author names ordered by (last, first) and distinct subjects ordered by
    name, each joined with ', ' (NULL when none)."""
    pub = t.publisher.select("publisher_id", F.col("name").alias("publisher_name"))
    return (t.book.join(pub, "publisher_id", "left")
            .join(book_authors(t), "isbn", "left")
            .join(book_subjects(t), "isbn", "left")
            .select("isbn", "title", "pub_year", "publisher_name", "authors", "subjects"))


def v02_copy_location(t: Tables) -> DataFrame:
    """Per copy: book title, branch (inner joins) and check-in term as 'name year' (NULL without a term)."""
    term = t.term.select("term_id", F.concat(F.col("name"), F.lit(" "), F.col("year").cast("string"))
                         .alias("checkin_term"))
    br = t.branch.select("branch_id", F.col("name").alias("branch_name"))
    c = t.copy.join(t.book.select("isbn", "title"), "isbn").join(br, "branch_id")
    return (c.join(term, c.checkin_term_id == term.term_id, "left")
            .select("copy_id", "barcode", "isbn", "title", "branch_id", "branch_name",
                    F.col("term_id").alias("checkin_term_id"), "checkin_term"))


def v03_patron_contact(t: Tables) -> DataFrame:
    """Per patron: contact columns with city, state and country of the address (left join)."""
    addr = t.address.select("address_id", "city", "state", "country")
    return (t.patron.join(addr, "address_id", "left")
            .select("patron_id", "first_name", "last_name", "email", "patron_type", "balance",
                    "city", "state", "country"))


def fine_totals(t: Tables) -> DataFrame:
    """patron_id -> total_fines, unpaid_fines (only patrons that have fines)."""
    return t.fine.groupBy("patron_id").agg(
        F.sum("amount").alias("total_fines"),
        F.sum(F.when(F.col("status") == "Unpaid", F.col("amount")).otherwise(0)).alias("unpaid_fines"))


def v04_patron_fines_summary(t: Tables) -> DataFrame:
    """Per patron: total fines and unpaid fines, 0 when the patron has none."""
    zero = F.lit(0).cast("decimal(18,2)")
    return (t.patron.join(fine_totals(t), "patron_id", "left")
            .select("patron_id", "first_name", "last_name", "email",
                    F.coalesce(F.col("total_fines").cast("decimal(18,2)"), zero).alias("total_fines"),
                    F.coalesce(F.col("unpaid_fines").cast("decimal(18,2)"), zero).alias("unpaid_fines")))


def _loan_detail(t: Tables, loans: DataFrame) -> DataFrame:
    pat = t.patron.select("patron_id", full_name().alias("patron_name"))
    return (loans.join(t.copy.select("copy_id", "barcode", "isbn"), "copy_id")
            .join(t.book.select("isbn", "title"), "isbn")
            .join(pat, "patron_id"))


def v05_current_loans(t: Tables) -> DataFrame:
    """Open loans (no return time) with copy barcode, book and patron name."""
    open_loans = t.loan.filter(F.col("return_ts").isNull())
    return _loan_detail(t, open_loans).select(
        "loan_id", "copy_id", "barcode", "isbn", "title", "patron_id", "patron_name", "loan_ts", "due_ts")


def v06_overdue_loans(t: Tables, as_of=None) -> DataFrame:
    """Open loans whose due timestamp is before 'now' (``as_of``; a date means midnight)."""
    late = t.loan.filter(F.col("return_ts").isNull() & (F.col("due_ts") < as_timestamp(as_of)))
    return _loan_detail(t, late).select(
        "loan_id", "copy_id", "barcode", "isbn", "title", "patron_id", "patron_name", "loan_ts", "due_ts")


def v07_patron_loans_with_status(t: Tables, as_of=None) -> DataFrame:
    """Every loan with copy, book, patron name and status Returned / Overdue (due before ``as_of``) / On loan."""
    status = (F.when(F.col("return_ts").isNotNull(), "Returned")
              .when(F.col("due_ts") < as_timestamp(as_of), "Overdue").otherwise("On loan"))
    return _loan_detail(t, t.loan).select(
        "loan_id", "patron_id", "patron_name", "copy_id", "barcode", "isbn", "title",
        "loan_ts", "due_ts", "return_ts", status.alias("loan_status"))


def v08_copy_inventory_by_branch(t: Tables) -> DataFrame:
    """Number of copies per (branch, book) with branch name and title."""
    counts = t.copy.groupBy("branch_id", "isbn").agg(F.count(F.lit(1)).alias("num_copies"))
    br = t.branch.select("branch_id", F.col("name").alias("branch_name"))
    return (counts.join(br, "branch_id").join(t.book.select("isbn", "title"), "isbn")
            .select("branch_id", "branch_name", "isbn", "title", "num_copies"))


def v09_eresource_usage_summary(t: Tables) -> DataFrame:
    """Per e-resource: type name, sessions and distinct patrons (0 for resources never used)."""
    use = t.accesssession.groupBy("resource_id").agg(
        F.count("session_id").alias("total_sessions"), F.countDistinct("patron_id").alias("distinct_patrons"))
    rt = t.resourcetype.select("resource_type_id", F.col("name").alias("resource_type"))
    return (t.eresource.join(rt, "resource_type_id").join(use, "resource_id", "left")
            .select("resource_id", "title", "resource_type",
                    F.coalesce("total_sessions", F.lit(0).cast("bigint")).alias("total_sessions"),
                    F.coalesce("distinct_patrons", F.lit(0).cast("bigint")).alias("distinct_patrons")))


def v10_illrequest_detail(t: Tables) -> DataFrame:
    """Inter-library requests with book title, patron name and partner library name."""
    pat = t.patron.select("patron_id", full_name().alias("patron_name"))
    pl = t.partnerlibrary.select("partner_id", F.col("name").alias("partner_name"))
    return (t.illrequest.join(pat, "patron_id").join(pl, "partner_id")
            .join(t.book.select("isbn", F.col("title").alias("book_title")), "isbn")
            .select("request_id", "status", "requested_at", "isbn", "book_title", "patron_id", "patron_name",
                    "partner_id", "partner_name"))


VIEWS = {
    "vw_book_details": v01_book_details,
    "vw_copy_location": v02_copy_location,
    "vw_patron_contact": v03_patron_contact,
    "vw_patron_fines_summary": v04_patron_fines_summary,
    "vw_current_loans": v05_current_loans,
    "vw_overdue_loans": v06_overdue_loans,
    "vw_patron_loans_with_status": v07_patron_loans_with_status,
    "vw_copy_inventory_by_branch": v08_copy_inventory_by_branch,
    "vw_eresource_usage_summary": v09_eresource_usage_summary,
    "vw_illrequest_detail": v10_illrequest_detail,
}


def register_views(t: Tables, as_of=None) -> None:
    """Catalog of named views: every view becomes a temp view usable from ``spark.sql``."""
    for name, fn in VIEWS.items():
        df = fn(t, as_of) if name in ("vw_overdue_loans", "vw_patron_loans_with_status") else fn(t)
        df.createOrReplaceTempView(name)


def view_counts(t: Tables, as_of=None) -> DataFrame:
    """Rows of every named view, asked through SQL on the registered names."""
    register_views(t, as_of)
    return t.patron.sparkSession.sql(" UNION ALL ".join(
        f"SELECT '{name}' AS view_name, count(*) AS num_rows FROM {name}" for name in VIEWS))
