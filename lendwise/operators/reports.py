"""Parameterized reports D-01 ... D-06, the route-only queries A-01 ... A-12 and display helpers F-16 ... F-18.

Every time-relative report takes ``as_of`` explicitly ('today' / 'now'); nothing reads the wall clock.
Each report pre-aggregates the fact tables on their own key before joining (patron history, fine sums,
loans per copy), then joins small per-key results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendwise.functions import (as_date, days_between, display_date, display_datetime, exact_avg,
                                exact_avg_from_sums, full_name,
                                money, split_list)
from lendwise.operators import queries as Q
from lendwise.operators import views as V
from lendwise.operators.ranking import rank_within, top_k_ranked
from lendwise.operators.search import TitleIndex, matches
from lendwise.operators.search import fold as fold_column
from lendwise.sources.schemas import PIVOT_TYPES
from lendwise.sources.tables import Tables

BIG = "bigint"


def _minus_days(as_of, n: int):
    return F.date_sub(as_date(as_of), n)


# --------------------------------------------------------------------------------------------- D-01

def _dashboard(t: Tables, as_of, literal: bool) -> DataFrame:
    today, last7, last90 = as_date(as_of), _minus_days(as_of, 7), _minus_days(as_of, 90)
    books = t.book.select("isbn")
    copies_per_book = t.copy.groupBy("isbn").agg(F.count(F.lit(1)).alias("nc"))
    subjects_per_book = t.booksubject.groupBy("isbn").agg(F.count(F.lit(1)).alias("ns"))
    if literal:
        # COUNT(*) over Book LEFT JOIN Copy LEFT JOIN BookSubject = sum over books of max(1,copies)*max(1,subjects)
        fan = (books.join(copies_per_book, "isbn", "left").join(subjects_per_book, "isbn", "left")
               .select((F.greatest(F.coalesce("nc", F.lit(0)), F.lit(1))
                        * F.greatest(F.coalesce("ns", F.lit(0)), F.lit(1))).alias("rows")))
        total_books = fan.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast(BIG).alias("total_books"))
    else:
        total_books = books.agg(F.countDistinct("isbn").alias("total_books"))
    total_copies = (t.copy.join(books, "isbn", "left_semi")
                    .agg(F.countDistinct("copy_id").alias("total_copies")))
    total_subjects = (t.booksubject.join(books, "isbn", "left_semi")
                      .agg(F.countDistinct("subject_id").alias("total_subjects")))

    recent = (t.loan.filter(F.col("loan_ts") >= last90).groupBy("patron_id")
              .agg(F.count(F.lit(1)).alias("nr")))
    pat = t.patron.select("patron_id").join(recent, "patron_id", "left")
    if literal:
        # COUNT(*) after the LEFT JOIN counts a patron once per recent loan (at least once)
        total_patrons = F.coalesce(F.sum(F.greatest(F.coalesce("nr", F.lit(0)), F.lit(1))), F.lit(0)).cast(BIG)
    else:
        total_patrons = F.count(F.lit(1))
    patrons = pat.agg(total_patrons.alias("total_patrons"),
                      F.count("nr").alias("active_patrons_90d"))

    open_ = F.col("return_ts").isNull()
    dur = days_between(F.coalesce(F.col("return_ts"), today.cast("timestamp_ntz")), F.to_date("loan_ts"))
    def flag(cond):
        return F.when(cond, 1).otherwise(0)

    loans = t.loan.agg(
        F.count(F.lit(1)).alias("total_loans"),
        F.sum(flag(open_)).cast(BIG).alias("current_loans"),
        F.sum(flag(open_ & (F.col("due_ts") < today))).cast(BIG).alias("overdue_loans"),
        F.round(exact_avg(dur), 2).cast("decimal(18,2)").alias("avg_duration_days"),
        F.sum(flag(F.to_date("loan_ts") >= last7)).cast(BIG).alias("loans_last_7d"),
        F.sum(flag(F.to_date("return_ts") >= last7)).cast(BIG).alias("returns_last_7d"))
    # four one-row aggregates: the cross joins are of single rows
    return (total_books.crossJoin(total_copies).crossJoin(total_subjects).crossJoin(patrons).crossJoin(loans)
            .select("total_books", "total_copies", "total_subjects", "total_patrons", "active_patrons_90d",
                    "total_loans", "current_loans", "overdue_loans", "avg_duration_days", "loans_last_7d",
                    "returns_last_7d"))


def d01_dashboard_summary(t: Tables, as_of=None) -> DataFrame:
    """Dashboard counters exactly as the report's SQL computes them (fan-out counts included)."""
    return _dashboard(t, as_of, literal=True)


def d01_dashboard_summary_intent(t: Tables, as_of=None) -> DataFrame:
    """Dashboard counters with the stated meaning: distinct books, every patron once."""
    return _dashboard(t, as_of, literal=False)


# --------------------------------------------------------------------------------------------- D-02

def patron_history(t: Tables, as_of=None) -> DataFrame:
    """patron_id -> all_loans, overdue_or_late_loans (every patron; zero when no loans)."""
    today = as_date(as_of)
    late = ((F.col("return_ts").isNull() & (F.col("due_ts") < today))
            | (F.col("return_ts").isNotNull() & (F.col("return_ts") > F.col("due_ts"))))
    per = t.loan.groupBy("patron_id").agg(F.count("loan_id").alias("all_loans"),
                                          F.sum(late.cast("int")).cast(BIG).alias("overdue_or_late_loans"))
    return (t.patron.select("patron_id").join(per, "patron_id", "left")
            .select("patron_id", F.coalesce("all_loans", F.lit(0).cast(BIG)).alias("all_loans"),
                    F.coalesce("overdue_or_late_loans", F.lit(0).cast(BIG)).alias("overdue_or_late_loans")))


def overdue_risk_rows(t: Tables, as_of=None) -> DataFrame:
    """Loans open and due before ``as_of`` with days overdue, patron history, unpaid fines and risk score (NULL
    when the patron has no fine row)."""
    today = as_date(as_of)
    overdue = (t.loan.filter(F.col("return_ts").isNull() & (F.col("due_ts") < today))
               .select("loan_id", "patron_id", "copy_id", "due_ts",
                       days_between(today, F.to_date("due_ts")).alias("days_overdue")))
    fines = V.fine_totals(t).select("patron_id", F.col("unpaid_fines").cast("decimal(18,2)").alias("unpaid_fines"))
    score = (F.col("days_overdue") * F.lit(1.0).cast("decimal(2,1)")
             + F.col("overdue_or_late_loans") * F.lit(2.0).cast("decimal(2,1)")
             + F.col("unpaid_fines") / F.lit(10.0).cast("decimal(3,1)"))
    return (overdue.join(t.patron.select("patron_id", full_name().alias("patron_name")), "patron_id")
            .join(t.copy.select("copy_id", "isbn"), "copy_id")
            .join(t.book.select("isbn", F.col("title").alias("book_title")), "isbn")
            .join(patron_history(t, as_of), "patron_id", "left")
            .join(fines, "patron_id", "left")
            .select("loan_id", "patron_id", "patron_name", "book_title", F.to_date("due_ts").alias("due_date"),
                    "days_overdue", "all_loans", "overdue_or_late_loans", "unpaid_fines",
                    score.cast("decimal(20,6)").alias("risk_score")))


def d02_overdue_risk(t: Tables, as_of=None, limit: int | None = None) -> DataFrame:
    """Overdue loans with a risk score and its global RANK (descending score; NULL scores rank last).

    Without ``limit`` the rank is computed by the distributed prefix-count rank (no single-partition window);
    with ``limit`` the top rows are taken first and ranked among themselves (exact for the kept rows)."""
    rows = overdue_risk_rows(t, as_of)
    order = [("risk_score", True)]
    if limit:
        # rows are kept in the report's order (score, days overdue); the rank itself is by score only
        ranked = top_k_ranked(rows, order + [("days_overdue", True)], ["loan_id"], limit, rank="risk_rank",
                              rank_on=1)
    else:
        ranked = rank_within(rows, order_by=order, rank="risk_rank")
    return (ranked.drop("patron_id")
            .orderBy(F.col("risk_score").desc_nulls_last(), F.desc("days_overdue"), "loan_id"))


def d02_overdue_risk_top(t: Tables, as_of=None, k: int = 10) -> DataFrame:
    """Dashboard route form: top ``k`` overdue loans by score, with patron_id and without the rank."""
    return (overdue_risk_rows(t, as_of)
            .orderBy(F.col("risk_score").desc_nulls_last(), F.desc("days_overdue"), "loan_id").limit(k))


# --------------------------------------------------------------------------------------------- D-03

def _matches(df: DataFrame, column: str, text: str):
    """Case-insensitive substring test. Binary text uses ILIKE (user '%'/'_' act as wildcards); text under a
    case/accent-insensitive collation uses ``contains``, which honours the collation."""
    dtype = df.schema[column].dataType
    if getattr(dtype, "collation", "UTF8_BINARY") not in ("UTF8_BINARY", None):
        return F.col(column).contains(F.lit(text))
    return F.col(column).ilike(f"%{text}%")


def d03_book_catalog(t: Tables, search: str | None = None, subject_id: int | None = None, fold: bool = False,
                     index: TitleIndex | None = None) -> DataFrame:
    """Catalog with popularity, availability and rank within the primary (smallest id) subject.

    The search (case-insensitive substring of title or ISBN; '%' and '_' typed by the user act as wildcards)
    and the subject filter are applied before the rank, so ranks are among matching books only. With ``fold`` the match
    ignores accents too, as the source database's collation does: the searched columns alone are folded, all joins stay
    binary. A stored ``index`` (``operators.search``) finds the same books by the postings of the needle's trigrams."""
    books = t.book
    if search and index is not None:
        books = books.join(index.search(books.sparkSession, search).select("isbn").distinct(), "isbn", "left_semi")
    elif search and fold:
        books = books.filter(matches(fold_column(F.col("title")), search) | matches(fold_column(F.col("isbn")), search))
    elif search:
        books = books.filter(_matches(books, "title", search) | _matches(books, "isbn", search))
    first = t.booksubject.groupBy("isbn").agg(F.min("subject_id").alias("primary_subject_id"))
    core = books.join(first, "isbn", "left")
    if subject_id is not None:
        core = core.filter(F.col("primary_subject_id") == subject_id)
    if search or subject_id is not None:
        # only the matching books' links and copies are aggregated, and only their copies' loans
        only = core.select("isbn")
        t = t.replace(copy=t.copy.join(only, "isbn", "left_semi"), bookauthor=t.bookauthor.join(only, "isbn", "left_semi"),
                      booksubject=t.booksubject.join(only, "isbn", "left_semi"))
    # one row per copy with its loans and open loans, then one per book
    use = t.loan.groupBy("copy_id").agg(F.count("loan_id").alias("n"), F.count(F.when(F.col("return_ts").isNull(), 1)).alias("o"))
    shelf = (t.copy.select("copy_id", "isbn").join(use, "copy_id", "left").groupBy("isbn").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast(BIG).alias("times_loaned"), F.count("copy_id").alias("total_copies"),
        F.sum((F.coalesce("o", F.lit(0)) == 0).cast("int")).cast(BIG).alias("available_copies")))
    pub = t.publisher.select("publisher_id", F.col("name").alias("publisher_name"))
    subj = t.subject.select(F.col("subject_id").alias("primary_subject_id"), F.col("name").alias("primary_subject"))
    rows = (core.join(pub, "publisher_id", "left")
            .join(V.book_authors(t), "isbn", "left").join(V.book_subjects(t), "isbn", "left")
            .join(shelf, "isbn", "left").join(subj, "primary_subject_id", "left")
            .select("isbn", "title", "pub_year", "publisher_name", "authors", "subjects",
                    F.coalesce("times_loaned", F.lit(0).cast(BIG)).alias("times_loaned"),
                    F.coalesce("total_copies", F.lit(0).cast(BIG)).alias("total_copies"),
                    # a book without copies keeps one NULL-extended row that counts as available
                    F.coalesce("available_copies", F.lit(1).cast(BIG)).alias("available_copies"),
                    "primary_subject", "primary_subject_id"))
    ranked = rank_within(rows, partition_by=["primary_subject_id"],
                         order_by=[("times_loaned", True), ("title", False)], rank="subject_popularity_rank")
    return ranked.drop("primary_subject_id").orderBy(F.desc("times_loaned"), "title", "isbn")


# --------------------------------------------------------------------------------------------- D-04

RISK_ORDER = {"HIGH": 1, "MEDIUM": 2}  # fixed values: route ordering of risk levels (others last)


def _risk_profile(t: Tables, as_of=None) -> DataFrame:
    today = as_date(as_of)
    open_ = F.col("return_ts").isNull()
    per = t.loan.groupBy("patron_id").agg(
        F.count("loan_id").alias("total_loans"), F.sum(open_.cast("int")).cast(BIG).alias("active_loans"),
        F.sum((open_ & (F.col("due_ts") < today)).cast("int")).cast(BIG).alias("overdue_loans"),
        F.max("loan_ts").alias("last_loan_ts"))
    fines = V.fine_totals(t)
    zero_m = F.lit(0).cast("decimal(18,2)")
    p = (t.patron.join(per, "patron_id", "left").join(fines, "patron_id", "left")
         .select("patron_id", "first_name", "last_name", "email", "patron_type", "balance",
                 F.coalesce("total_loans", F.lit(0).cast(BIG)).alias("total_loans"),
                 # a patron without loans has one NULL-extended row whose return_ts IS NULL: counted as active
                 F.coalesce("active_loans", F.lit(1).cast(BIG)).alias("active_loans"),
                 F.coalesce("overdue_loans", F.lit(0).cast(BIG)).alias("overdue_loans"),
                 "last_loan_ts",
                 F.coalesce(F.col("total_fines").cast("decimal(18,2)"), zero_m).alias("total_fines"),
                 F.coalesce(F.col("unpaid_fines").cast("decimal(18,2)"), zero_m).alias("unpaid_fines")))
    u, o = F.col("unpaid_fines"), F.col("overdue_loans")
    level = (F.when((u >= 50) | (o >= 3), "HIGH")
             .when(u.between(10, 49) | o.between(1, 2), "MEDIUM").otherwise("LOW"))
    return p.withColumn("risk_level", level)


def d04_patron_risk_profile(t: Tables, as_of=None) -> DataFrame:
    """Per patron: loans (total, active, overdue), last loan, fines, risk level and recent-borrower flag (30 days)."""
    cutoff = _minus_days(as_of, 30)
    recent = (F.col("last_loan_ts").isNotNull() & (F.to_date("last_loan_ts") >= cutoff)).cast("int")
    return (_risk_profile(t, as_of)
            .select("patron_id", full_name().alias("patron_name"), "email", "patron_type", "balance", "total_loans",
                    "active_loans", "overdue_loans", "last_loan_ts", "total_fines", "unpaid_fines", "risk_level",
                    recent.alias("is_recent_borrower"))
            # the report's ORDER BY risk_level DESC is a text sort: MEDIUM, LOW, HIGH
            .orderBy(F.desc("risk_level"), F.desc("unpaid_fines"), "patron_name", "patron_id"))


def d04_patron_risk_route(t: Tables, as_of=None) -> DataFrame:
    """Patron list route form: names split, no recency flag, HIGH -> MEDIUM -> LOW then patron id."""
    lvl = F.col("risk_level")
    order = F.when(lvl == "HIGH", RISK_ORDER["HIGH"]).when(lvl == "MEDIUM", RISK_ORDER["MEDIUM"]).otherwise(3)
    return (_risk_profile(t, as_of)
            .select("patron_id", "first_name", "last_name", "email", "patron_type", "balance", "total_loans",
                    "active_loans", "overdue_loans", "last_loan_ts", "total_fines", "unpaid_fines", "risk_level")
            .orderBy(order, "patron_id"))


# --------------------------------------------------------------------------------------------- D-05

LOAN_STATUS_FILTERS = ("ALL", "CURRENT", "OVERDUE", "RETURNED")


def d05_loans_segmented(t: Tables, as_of=None, status_filter: str = "ALL", limit: int | None = None,
                        with_patron_id: bool = False) -> DataFrame:
    """Loans with branch, status and duration against the patron's average over all of the patron's loans.
    Unknown filters mean ALL (as the route maps them)."""
    today = as_date(as_of)
    st = (F.when(F.col("return_ts").isNotNull(), "RETURNED").when(F.col("due_ts") < today, "OVERDUE")
          .otherwise("CURRENT"))
    dur = days_between(F.coalesce(F.col("return_ts"), today.cast("timestamp_ntz")), F.to_date("loan_ts"))
    br = t.branch.select("branch_id", F.col("name").alias("branch_name"))
    # copies with book and branch: the only loans that count are those of such copies
    shelf = (t.copy.select("copy_id", "barcode", "isbn", "branch_id").join(t.book.select("isbn", "title"), "isbn")
             .join(br, "branch_id").drop("branch_id"))
    # the averages come from three narrow columns, shuffled once for the copies they may count
    use = t.loan.select("patron_id", "copy_id", dur.alias("d")).join(shelf.select("copy_id"), "copy_id", "left_semi")
    per_patron = use.groupBy("patron_id").agg(
        exact_avg_from_sums(F.sum("d"), F.count(F.lit(1))).alias("avg_duration_per_patron"))
    # the patron's columns first, the wide ones of the shelf last: only the final sort shuffles titles and barcodes
    who = t.patron.select("patron_id", full_name().alias("patron_name")).join(per_patron, "patron_id", "left")
    rows = (t.loan.withColumn("status", st).withColumn("duration_days", dur).join(who, "patron_id")
            .join(shelf, "copy_id"))
    sf = status_filter.upper() if status_filter else "ALL"
    if sf in LOAN_STATUS_FILTERS and sf != "ALL":
        rows = rows.filter(F.col("status") == sf)
    d, a = F.col("duration_days"), F.col("avg_duration_per_patron")
    vs = F.when(d > a, "LONGER THAN USUAL").when(d < a, "SHORTER THAN USUAL").otherwise("TYPICAL")
    lead = ["loan_id", "patron_id"] if with_patron_id else ["loan_id"]
    out = (rows.select(*lead, "patron_name", "barcode", "isbn", "title", "branch_name", "loan_ts", "due_ts",
                       "return_ts", "status", "duration_days", "avg_duration_per_patron",
                       vs.alias("duration_vs_usual"))
           .orderBy(F.desc("loan_ts"), "loan_id"))
    return out.limit(limit) if limit else out


# --------------------------------------------------------------------------------------------- D-06

def d06_monthly_trends(t: Tables) -> DataFrame:
    """Loans per month by patron type (Student, Faculty, Staff, Alumni, other), total and running total."""
    ty = F.col("patron_type")
    cols = [F.sum(F.when(ty == name, F.col("n")).otherwise(0)).alias(f"{name.lower()}_loans") for name in PIVOT_TYPES]
    other = F.sum(F.when(~ty.isin(*PIVOT_TYPES), F.col("n")).otherwise(0)).alias("other_loans")
    monthly = Q.monthly_type_counts(t).groupBy("loan_month").agg(*cols, other, F.sum("n").alias("total_loans"))
    # one row per calendar month: the running total's single ordered window is bounded
    return (monthly.withColumn("running_total_loans", F.sum("total_loans").over(Window.orderBy("loan_month")))
            .orderBy("loan_month"))


# --------------------------------------------------------------------------------------------- A-01..A-12

def a01_total_unpaid(t: Tables) -> DataFrame:
    """Sum of unpaid fines (0 when there are none)."""
    return t.fine.filter(F.col("status") == "Unpaid").agg(
        F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(18,2)").alias("total_unpaid"))


def a02_subject_list(t: Tables) -> DataFrame:
    """Distinct subjects ordered by name."""
    return t.subject.select("subject_id", "name").distinct().orderBy("name", "subject_id")


def a03_book_detail(t: Tables, isbn: str) -> DataFrame:
    # list order is unspecified by the route; the (last, first) / name order of the view is used
    """V-01 for one ISBN."""
    return V.v01_book_details(t).filter(F.col("isbn") == isbn)


def a04_book_copies(t: Tables, isbn: str) -> DataFrame:
    """Copy id, barcode, branch and check-in term of one ISBN's copies."""
    return (V.v02_copy_location(t).filter(F.col("isbn") == isbn)
            .select("copy_id", "barcode", "branch_name", "checkin_term"))


def a05_patron_detail(t: Tables, patron_id: int) -> DataFrame:
    """One patron's columns with fine totals."""
    fs = V.v04_patron_fines_summary(t).select("patron_id", "total_fines", "unpaid_fines")
    return t.patron.filter(F.col("patron_id") == patron_id).join(fs, "patron_id", "left")


def a06_patron_loan_history(t: Tables, as_of, patron_id: int) -> DataFrame:
    """One patron's loans with status, newest first."""
    return (V.v07_patron_loans_with_status(t, as_of).filter(F.col("patron_id") == patron_id)
            .select("loan_id", "copy_id", "barcode", "isbn", "title", "loan_ts", "due_ts", "return_ts", "loan_status")
            .orderBy(F.desc("loan_ts"), "loan_id"))


def a07_patron_fines(t: Tables, patron_id: int) -> DataFrame:
    """One patron's total and unpaid fines."""
    return (V.v04_patron_fines_summary(t).filter(F.col("patron_id") == patron_id)
            .select("total_fines", "unpaid_fines"))


def a08_open_fines(t: Tables) -> DataFrame:
    """Patrons with unpaid fines, largest first."""
    return (V.v04_patron_fines_summary(t).filter(F.col("unpaid_fines") > 0)
            .orderBy(F.desc("unpaid_fines"), "patron_id"))


def a09_top_books(t: Tables, k: int = 10) -> DataFrame:
    """The ``k`` most loaned books (ties by title, ISBN)."""
    return Q.q10_popular_books(t).limit(k)


def a10_top_patrons(t: Tables, k: int = 10) -> DataFrame:
    """The ``k`` patrons with most loans (ties by patron id)."""
    return Q.q09_top_patrons(t, k)


def a11_payment_band(t: Tables) -> DataFrame:
    """Fine analysis with the template's badge: >= 80 success, >= 50 warning, otherwise (also NULL/0) danger."""
    r = F.col("payment_rate_pct")
    band = F.when(r.isNotNull() & (r != 0) & (r >= 80), "success").when(
        r.isNotNull() & (r != 0) & (r >= 50), "warning").otherwise("danger")
    return Q.q23_fine_analysis(t).withColumn("payment_band", band)


def a12_row_position(t: Tables, k: int = 10) -> DataFrame:
    """1-based display position of the top-k books (the window runs over the k kept rows only)."""
    top = a09_top_books(t, k)
    w = Window.orderBy(F.desc("times_loaned"), "title", "isbn")
    return top.withColumn("position", F.row_number().over(w))


def f16_dateformat(t: Tables) -> DataFrame:
    """Template date filter over loan dates: typed timestamps and their text form, NULL shown as N/A."""
    return t.loan.select("loan_id", display_datetime("loan_ts").alias("loan_date"),
                         display_datetime("return_ts").alias("return_date"),
                         display_date(F.col("due_ts").cast("string")).alias("due_date_text"),
                         display_date(F.date_format("loan_ts", "dd/MM/yyyy")).alias("unparsed_text"))


def f17_split_subjects(t: Tables) -> DataFrame:
    """Concatenated subject lists split back into one row per subject."""
    return (V.v01_book_details(t).filter(F.col("subjects").isNotNull())
            .select("isbn", F.explode(split_list("subjects")).alias("subject")))


def f18_money(t: Tables) -> DataFrame:
    """Money text of each patron's fine totals (NULL shows as 0.00)."""
    return V.v04_patron_fines_summary(t).select("patron_id", money("total_fines").alias("total_fines_text"),
                                                money("unpaid_fines").alias("unpaid_fines_text"))
