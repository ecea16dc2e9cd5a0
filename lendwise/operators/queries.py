"""Example queries Q-01 ... Q-30 (plus the two ``_intent`` variants) as DataFrame jobs.

Shape rules used throughout:
  * the loan fact table is aggregated on its own keys (copy_id, patron_id, month) before joining dimensions;
  * one-row aggregates (averages, maxima) are cross-joined: a single row is a proven broadcast size;
  * orderings carry a primary-key tie-break so top-k results are deterministic;
  * global orderings (``orderBy``) are range-partitioned sorts, top-k is TakeOrderedAndProject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendwise.functions import (as_timestamp, days_between, exact_avg, exact_avg_from_sums, full_name, month_key,
                                ordered_distinct_concat, pct, previous_month_key, year_key)
from lendwise.operators import views as V
from lendwise.operators.ranges import domain_of, range_join
from lendwise.sources.schemas import PIVOT_TYPES, RESERVATION_OPEN
from lendwise.sources.tables import Tables, spread


def _patron_names(t: Tables) -> DataFrame:
    return t.patron.select("patron_id", full_name().alias("patron_name"))


def loans_per_book(t: Tables) -> DataFrame:
    """isbn -> number of loans of its copies (books without loans absent)."""
    per_copy = t.loan.groupBy("copy_id").agg(F.count("loan_id").alias("n"))
    return (per_copy.join(t.copy.select("copy_id", "isbn"), "copy_id")
            .groupBy("isbn").agg(F.sum("n").alias("loan_count")))


def loans_per_book_all(t: Tables) -> DataFrame:
    """Every book with its loan count, zero when never loaned (Book LEFT JOIN Copy LEFT JOIN Loan)."""
    return (t.book.join(loans_per_book(t), "isbn", "left")
            .withColumn("loan_count", F.coalesce(F.col("loan_count"), F.lit(0)).cast("bigint")))


def loan_duration(as_of=None):
    """DATEDIFF(COALESCE(return_ts, now), loan_ts)."""
    return days_between(F.coalesce(F.col("return_ts"), as_timestamp(as_of)), F.col("loan_ts"))


# --------------------------------------------------------------------------------------------- Q-01..Q-10

def q01_books_full(t: Tables) -> DataFrame:
    """V-01 ordered by title."""
    return V.v01_book_details(t).orderBy("title", "isbn")


def q02_books_in_subject(t: Tables, subject: str) -> DataFrame:
    """Books filed under the subject named ``subject``, ordered by title."""
    s = t.subject.filter(F.col("name") == subject).select("subject_id", F.col("name").alias("subject_name"))
    return (t.booksubject.join(s, "subject_id").join(t.book.select("isbn", "title"), "isbn")
            .select("isbn", "title", "subject_name").orderBy("title", "isbn"))


def q03_copies_of_isbn(t: Tables, isbn: str) -> DataFrame:
    """Locations of the copies of one ISBN (from V-02)."""
    return (V.v02_copy_location(t).filter(F.col("isbn") == isbn)
            .select("copy_id", "barcode", "isbn", "title", "branch_name", "checkin_term"))


def q04_inventory_by_branch(t: Tables) -> DataFrame:
    """V-08 ordered by branch name and title."""
    return (V.v08_copy_inventory_by_branch(t).select("branch_name", "isbn", "title", "num_copies")
            .orderBy("branch_name", "title", "isbn"))


def q05_patron_fines(t: Tables) -> DataFrame:
    """V-04 ordered by unpaid fines (descending), last and first name."""
    return V.v04_patron_fines_summary(t).orderBy(
        F.desc("unpaid_fines"), "last_name", "first_name", "patron_id")


def q06_current_loans(t: Tables) -> DataFrame:
    """V-05 ordered by due time."""
    return V.v05_current_loans(t).orderBy("due_ts", "loan_id")


def q07_overdue_loans(t: Tables, as_of=None) -> DataFrame:
    """V-06 ordered by due time."""
    return V.v06_overdue_loans(t, as_of).orderBy("due_ts", "loan_id")


def q08_loans_with_status(t: Tables, as_of=None) -> DataFrame:
    """V-07 ordered by patron and loan time."""
    return V.v07_patron_loans_with_status(t, as_of).orderBy("patron_id", "loan_ts", "loan_id")


def patron_loan_counts(t: Tables) -> DataFrame:
    """Every patron with its number of loans (zero included)."""
    per = t.loan.groupBy("patron_id").agg(F.count("loan_id").alias("loan_count"))
    return (_patron_names(t).join(per, "patron_id", "left")
            .select("patron_id", "patron_name",
                    F.coalesce("loan_count", F.lit(0).cast("bigint")).alias("loan_count")))


def q09_top_patrons(t: Tables, k: int = 5) -> DataFrame:
    """The ``k`` patrons with most loans (patrons without loans count 0; ties by patron id)."""
    return patron_loan_counts(t).orderBy(F.desc("loan_count"), "patron_id").limit(k)


def q10_popular_books(t: Tables) -> DataFrame:
    """Loans per book for books loaned at least once, most loaned first."""
    return (loans_per_book(t).join(t.book.select("isbn", "title"), "isbn")
            .select("isbn", "title", F.col("loan_count").cast("bigint").alias("times_loaned"))
            .orderBy(F.desc("times_loaned"), "title", "isbn"))


# --------------------------------------------------------------------------------------------- Q-11..Q-20

def q11_above_avg_copies(t: Tables) -> DataFrame:
    """Books with more copies than the average number of copies per ISBN."""
    per_isbn = t.copy.groupBy("isbn").agg(F.count("copy_id").alias("copy_count"))
    avg_row = per_isbn.agg(exact_avg("copy_count").alias("avg_copies"))  # one row
    return (per_isbn.join(t.book.select("isbn", "title"), "isbn").crossJoin(avg_row)
            .filter(F.col("copy_count") > F.col("avg_copies"))
            .select("isbn", "title", "copy_count").orderBy(F.desc("copy_count"), "isbn"))


def q12_fine_rank(t: Tables) -> DataFrame:
    """Patrons with fines ranked by total fines inside their patron type: ROW_NUMBER (ties by patron id), RANK and
    DENSE_RANK, computed with the skew-safe rank."""
    from lendwise.operators.ranking import rank_within
    fines = (V.v04_patron_fines_summary(t).filter(F.col("total_fines") > 0)
             .join(t.patron.select("patron_id", "patron_type"), "patron_id")
             .select("patron_id", "first_name", "last_name", "patron_type", "total_fines", "unpaid_fines"))
    ranked = rank_within(fines, partition_by=["patron_type"], order_by=[("total_fines", True)],
                         tie_break=["patron_id"], row_number="row_num", rank="rank_fines",
                         dense_rank="dense_rank_fines")
    return ranked.orderBy("patron_type", F.desc("total_fines"), "row_num")


def q13_duration_lag(t: Tables, as_of=None) -> DataFrame:
    """Each returned loan's duration next to the patron's previous returned loan (LAG over loan_ts, loan_id).
    The previous row comes from ``ranking.lag_within`` so a patron with a huge history is not one task."""
    from lendwise.operators.ranking import lag_within
    base = (V.v07_patron_loans_with_status(t, as_of).filter(F.col("return_ts").isNotNull())
            .select("loan_id", "patron_id", "isbn", "title", "loan_ts", "return_ts",
                    loan_duration(as_of).alias("loan_duration_days")))
    lagged = lag_within(base, ["patron_id"], [("loan_ts", False), ("loan_id", False)], "loan_duration_days",
                        "prev_loan_duration")
    return (lagged.withColumn("duration_diff", F.col("loan_duration_days") - F.col("prev_loan_duration"))
            .orderBy("patron_id", "loan_ts", "loan_id"))


def q14_multi_branch_patrons(t: Tables) -> DataFrame:
    """Patrons who borrowed from more than one branch: number of branches, loans and the sorted branch list."""
    br = t.branch.select("branch_id", F.col("name").alias("branch_name"))
    # one row per (patron, copy) before the copy join, then per (patron, branch)
    per_copy = t.loan.groupBy("patron_id", "copy_id").agg(F.count("loan_id").alias("n"))
    per_branch = (per_copy.join(t.copy.select("copy_id", "branch_id"), "copy_id")
                  .groupBy("patron_id", "branch_id").agg(F.sum("n").alias("loans_at_branch"))
                  .join(br, "branch_id"))
    multi = (per_branch.groupBy("patron_id").agg(
        F.countDistinct("branch_id").alias("num_branches"),
        F.sum("loans_at_branch").alias("total_loans"),
        ordered_distinct_concat("branch_name").alias("branches_used"))
        .filter(F.col("num_branches") > 1))
    return (multi.join(_patron_names(t), "patron_id")
            .select("patron_id", "patron_name", "num_branches", "total_loans", "branches_used")
            .orderBy(F.desc("num_branches"), F.desc("total_loans"), "patron_id"))


POPULARITY_BUCKETS = (  # fixed values: labels and bounds of the popularity categories
    "Never Loaned", "Low Popularity (1-5 loans)", "Medium Popularity (6-15 loans)",
    "High Popularity (16-30 loans)", "Very High Popularity (30+ loans)")


def q15_popularity_buckets(t: Tables) -> DataFrame:
    """Books grouped by loan count into five popularity buckets with count, average, min, max and sum of loans."""
    n = F.col("loan_count")
    b = POPULARITY_BUCKETS
    cat = (F.when(n == 0, b[0]).when(n.between(1, 5), b[1]).when(n.between(6, 15), b[2])
           .when(n.between(16, 30), b[3]).otherwise(b[4]))
    order = (F.when(F.col("popularity_category") == b[0], 1).when(F.col("popularity_category") == b[1], 2)
             .when(F.col("popularity_category") == b[2], 3).when(F.col("popularity_category") == b[3], 4)
             .otherwise(5))
    return (loans_per_book_all(t).groupBy(cat.alias("popularity_category")).agg(
        F.count(F.lit(1)).alias("num_books"), exact_avg("loan_count").alias("avg_loans_per_book"),
        F.min("loan_count").alias("min_loans"), F.max("loan_count").alias("max_loans"),
        F.sum("loan_count").alias("total_loans"))
        .orderBy(order))


def q16_reserved_never_borrowed(t: Tables) -> DataFrame:
    """Patrons with Active/Waiting reservations and no loan at all, with their number of such reservations."""
    res = (t.reservation.filter(F.col("status").isin(*RESERVATION_OPEN))
           .groupBy("patron_id").agg(F.count("reservation_id").alias("active_reservations"))
           .join(t.loan.select("patron_id").distinct(), "patron_id", "left_anti"))
    return (res.join(t.patron, "patron_id")
            .select("patron_id", full_name().alias("patron_name"), "email", "patron_type", "active_reservations")
            .orderBy(F.desc("active_reservations"), "patron_name", "patron_id"))


def q17_never_loaned_copies(t: Tables) -> DataFrame:
    """Per book: the copies that were never loaned and the number of branches holding them."""
    idle = t.copy.join(t.loan.select("copy_id").distinct(), "copy_id", "left_anti")
    return (idle.join(t.book.select("isbn", "title"), "isbn")
            .groupBy("isbn", "title").agg(F.countDistinct("copy_id").alias("num_copies"),
                                          F.countDistinct("branch_id").alias("num_branches"))
            .orderBy(F.desc("num_copies"), "title", "isbn"))


def _overdue_items(t: Tables, as_of=None) -> DataFrame:
    now = as_timestamp(as_of)
    return V.v06_overdue_loans(t, as_of).select(
        F.lit("Overdue Loan").alias("item_type"), F.col("loan_id").cast("string").alias("item_id"),
        F.concat(F.lit("Patron: "), F.col("patron_name"), F.lit(" - Book: "), F.col("title")).alias("description"),
        F.col("due_ts").alias("action_date"), days_between(now, F.col("due_ts")).alias("days_overdue"))


def _reserved_items(t: Tables, as_of, blocked_isbns: DataFrame) -> DataFrame:
    now = as_timestamp(as_of)
    reserved = (t.reservation.filter(F.col("status").isin(*RESERVATION_OPEN))
                .groupBy("isbn").agg(F.max("created_at").alias("action_date")))
    return (reserved.join(t.book.select("isbn", "title"), "isbn")
            .join(blocked_isbns.distinct(), "isbn", "left_anti")
            .select(F.lit("No Copies Available").alias("item_type"), F.col("isbn").alias("item_id"),
                    F.concat(F.lit("Book: "), F.col("title"),
                             F.lit(" has reservations but no available copies")).alias("description"),
                    "action_date", days_between(now, F.col("action_date")).alias("days_overdue")))


def q18_action_items(t: Tables, as_of=None) -> DataFrame:
    """Literal form: a reserved book is listed unless one of its copies was never loaned or is on loan
    (the NOT EXISTS over Copy LEFT JOIN Loan with ``return_ts IS NULL``)."""
    # one row per loaned copy: whether any of its loans is open
    use = t.loan.groupBy("copy_id").agg(F.max(F.col("return_ts").isNull()).alias("busy"))
    blocked = t.copy.join(use, "copy_id", "left").filter(F.coalesce("busy", F.lit(True))).select("isbn")
    return _overdue_items(t, as_of).unionByName(_reserved_items(t, as_of, blocked)).orderBy("action_date", "item_id")


def q18_action_items_intent(t: Tables, as_of=None) -> DataFrame:
    """Stated intent: a reserved book is listed when none of its copies is free (every copy has an open
    loan, or the book has no copies)."""
    open_copies = t.loan.filter(F.col("return_ts").isNull()).select("copy_id").distinct()
    free = t.copy.join(open_copies, "copy_id", "left_anti").select("isbn")
    return _overdue_items(t, as_of).unionByName(_reserved_items(t, as_of, free)).orderBy("action_date", "item_id")


def q19_repeat_borrowers(t: Tables) -> DataFrame:
    """(patron, book) pairs with more than one loan: count, first and last loan and the days between them."""
    # few patrons borrow a copy twice: the loans are dealt by (patron, book) as they are, and grouped where they arrive
    loans = t.loan.select("loan_id", "patron_id", "copy_id", "loan_ts").join(t.copy.select("copy_id", "isbn"), "copy_id")
    g = (spread(loans.select("loan_id", "patron_id", "isbn", "loan_ts"), "patron_id", "isbn", tasks=t.tasks)
         .groupBy("patron_id", "isbn").agg(F.count("loan_id").alias("times_borrowed"),
                                           F.min("loan_ts").alias("first_loan"), F.max("loan_ts").alias("last_loan"))
         .filter(F.col("times_borrowed") > 1))
    return (g.join(_patron_names(t), "patron_id").join(t.book.select("isbn", "title"), "isbn")
            .select("patron_id", "patron_name", "isbn", "title", "times_borrowed", "first_loan", "last_loan",
                    days_between("last_loan", "first_loan").alias("days_between_first_last"))
            .orderBy(F.desc("times_borrowed"), "patron_name", "title", "patron_id", "isbn"))


def q20_slow_branches(t: Tables, as_of=None) -> DataFrame:
    """Branches whose average loan duration exceeds the average over all loans."""
    # loans are reduced to one row per (copy, patron); sums and counts then recombine the averages exactly
    use = t.loan.groupBy("copy_id", "patron_id").agg(F.count("loan_id").alias("n"), F.sum(loan_duration(as_of)).alias("d"))
    overall = use.agg(exact_avg_from_sums(F.sum("d"), F.sum("n")).alias("overall_avg_duration"))  # one row
    people = use.join(t.copy.select("copy_id", "branch_id"), "copy_id").groupBy("branch_id", "patron_id").agg(
        F.sum("n").alias("n"), F.sum("d").alias("d"))
    per = people.groupBy("branch_id").agg(F.sum("n").alias("total_loans"), F.count("patron_id").alias("unique_patrons"),
                                          exact_avg_from_sums(F.sum("d"), F.sum("n")).alias("avg_loan_duration_days"))
    return (per.join(t.branch.select("branch_id", F.col("name").alias("branch_name")), "branch_id")
            .crossJoin(overall)
            .filter(F.col("avg_loan_duration_days") > F.col("overall_avg_duration"))
            .select("branch_id", "branch_name", "total_loans", "unique_patrons", "avg_loan_duration_days",
                    "overall_avg_duration")
            .orderBy(F.desc("avg_loan_duration_days"), "branch_id"))


# --------------------------------------------------------------------------------------------- Q-21..Q-30

def monthly_loan_counts(t: Tables) -> DataFrame:
    """loan_month -> loans (one row per month: the only input of the month-level windows)."""
    return (t.loan.filter(F.col("loan_ts").isNotNull()).groupBy(month_key("loan_ts").alias("loan_month"))
            .agg(F.count(F.lit(1)).alias("loans_in_month")))


def q21_monthly_running(t: Tables) -> DataFrame:
    """Loans per month with running total, share of all loans and ratio to the previous month (percent)."""
    m = monthly_loan_counts(t)
    # month-sized input (one row per calendar month): a single ordered window partition is bounded
    w = Window.orderBy("loan_month")
    total = m.agg(F.sum("loans_in_month").alias("all_loans"))  # one row
    return (m.crossJoin(total)
            .select("loan_month", "loans_in_month",
                    F.sum("loans_in_month").over(w).alias("running_total_loans"),
                    pct(F.col("loans_in_month"), F.col("all_loans")).alias("percentage_of_total"),
                    pct(F.col("loans_in_month"), F.lag("loans_in_month").over(w)).alias("pct_change_from_prev_month"))
            .orderBy("loan_month"))


def q22_subject_patterns(t: Tables, patron_id=None, min_total: int = 5, limit: int | None = None) -> DataFrame:
    """Per patron and subject: loans and distinct books, and the share of the patron's subject-weighted total, for
    patrons whose total is at least ``min_total`` (optionally one patron, optionally the first ``limit`` rows)."""
    loans = t.loan.select("loan_id", "patron_id", "copy_id")
    if patron_id is not None:
        loans = loans.filter(F.col("patron_id") == patron_id)
    one = F.count(F.lit(1))
    subj = t.subject.groupBy("subject_id", F.col("name").alias("subject_name")).agg(one.alias("_s"))
    # a book's subjects as one list, with how often each is stored; the list travels with the patron's loans of the book
    # and is taken apart where they are counted, so the shuffles carry a row per (patron, book) and not per subject
    listed = t.booksubject.groupBy("isbn", "subject_id").agg(one.alias("m")).groupBy("isbn").agg(
        F.collect_list(F.struct("subject_id", "m")).alias("subjects"))
    shelf = t.book.groupBy("isbn").agg(one.alias("b")).join(listed, "isbn")
    per_book = (spread(loans.join(t.copy.select("copy_id", "isbn"), "copy_id").select("loan_id", "patron_id", "isbn"),
                       "patron_id", "isbn", tasks=t.tasks)
                .groupBy("patron_id", "isbn").agg(F.count("loan_id").alias("n")))
    read = spread(per_book.join(shelf, "isbn").select("patron_id", (F.col("n") * F.col("b")).alias("n"), "subjects"),
                  "patron_id", tasks=t.tasks)
    # each loan counts once per subject of its book, so a subject's loan count is the sum over the patron's books
    psl = (read.select("patron_id", "n", F.inline("subjects"))
           .groupBy("patron_id", "subject_id")
           .agg(F.sum(F.col("n") * F.col("m")).alias("_n"), one.alias("unique_books"))
           .join(subj, "subject_id")
           .select("patron_id", "subject_id", "subject_name", (F.col("_n") * F.col("_s")).alias("loan_count"), "unique_books"))
    # patron totals by aggregation + join (one row per patron on the small side) rather than a window over
    # each patron's rows
    totals = psl.groupBy("patron_id").agg(F.sum("loan_count").alias("total_loans"))
    psl = psl.join(totals, "patron_id")
    out = (psl.filter(F.col("total_loans") >= min_total)
           .join(t.patron.select("patron_id", full_name().alias("patron_name"), "patron_type"), "patron_id")
           .select("patron_id", "patron_name", "patron_type", "subject_name", "loan_count", "unique_books",
                   pct(F.col("loan_count"), F.col("total_loans")).alias("pct_of_total_loans"))
           .orderBy("patron_id", F.desc("loan_count"), "subject_name"))
    return out.limit(limit) if limit else out


def q23_fine_analysis(t: Tables) -> DataFrame:
    """Per fine reason (also reasons without fines): count, sum, average, min and max amount, paid/unpaid sums and
    counts, payment rate."""
    st, amt = F.col("status"), F.col("amount")
    per = t.fine.groupBy("reason_id").agg(
        F.count("fine_id").alias("total_fines"), F.sum(amt).alias("total_amount"),
        F.avg(amt).alias("avg_amount"), F.min(amt).alias("min_amount"), F.max(amt).alias("max_amount"),
        F.sum(F.when(st == "Paid", amt).otherwise(0)).alias("paid_amount"),
        F.sum(F.when(st == "Unpaid", amt).otherwise(0)).alias("unpaid_amount"),
        F.count(F.when(st == "Paid", 1)).alias("paid_count"),
        F.count(F.when(st == "Unpaid", 1)).alias("unpaid_count"))
    zero_i, zero_m = F.lit(0).cast("bigint"), F.lit(0).cast("decimal(18,2)")
    # a reason without fines keeps one NULL-extended row: counts and conditional sums are 0, others NULL
    return (t.finereason.join(per, "reason_id", "left")
            .select(F.col("code").alias("fine_reason_code"), F.col("description").alias("fine_reason"),
                    F.coalesce("total_fines", zero_i).alias("total_fines"),
                    F.col("total_amount").cast("decimal(18,2)").alias("total_amount"),
                    F.col("avg_amount").cast("decimal(12,6)").alias("avg_amount"),
                    "min_amount", "max_amount",
                    F.coalesce(F.col("paid_amount").cast("decimal(18,2)"), zero_m).alias("paid_amount"),
                    F.coalesce(F.col("unpaid_amount").cast("decimal(18,2)"), zero_m).alias("unpaid_amount"),
                    F.coalesce("paid_count", zero_i).alias("paid_count"),
                    F.coalesce("unpaid_count", zero_i).alias("unpaid_count"),
                    pct(F.coalesce("paid_count", zero_i), F.coalesce("total_fines", zero_i)).alias("payment_rate_pct"))
            .orderBy(F.desc_nulls_last("total_amount"), "fine_reason_code"))


def patron_months(t: Tables) -> DataFrame:
    """(patron, 'yyyy-MM') -> number of loans."""
    return (t.loan.groupBy("patron_id", month_key("loan_ts").alias("loan_month"))
            .agg(F.count(F.lit(1)).alias("loans_in_month")))


def _month_index(month: Column) -> Column:
    """'yyyy-MM' as a number that grows by one a month."""
    return (F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")).cast("int")


def j07_loans_from_month(t: Tables) -> DataFrame:
    """Each month in which a patron starts to borrow again (no loans the month before), with each of the patron's months
    from then on and its loans: the join of equal patrons and ``loan_month >= start_month``, through month ranges."""
    months = patron_months(t).withColumn("_m", _month_index(F.col("loan_month")))
    before = months.select("patron_id", (F.col("_m") + 1).alias("_from"))
    starts = months.select("patron_id", F.col("loan_month").alias("start_month"), F.col("_m").alias("_from")).join(
        before, ["patron_id", "_from"], "left_anti")
    # the ends of the calendar come from the loans themselves, one row
    ends = t.loan.select(F.year("loan_ts") * 12 + F.month("loan_ts")).toDF("_m")
    return range_join(months, starts, ["patron_id"], "_m", "_from", None, domain_of(ends, "_m")).select(
        "patron_id", "start_month", "loan_month", "loans_in_month")


def q24_consecutive_months(t: Tables) -> DataFrame:
    """Literal form: start months (no loans in the previous month) counted per (patron, month) - always 1 -
    then HAVING >= 3, so the result is always empty. Runs the full plan anyway.

    The loans from a start month onwards (the query's join to every later month of the patron) are a suffix
    sum over the patron's distinct months, so no month pairs are produced."""
    return (consecutive_month_starts(t).filter(F.col("consecutive_months") >= 3)
            .join(_patron_names(t), "patron_id")
            .select("patron_id", "patron_name", "start_month", "consecutive_months", "total_loans_in_period")
            .orderBy(F.desc("consecutive_months"), F.desc("total_loans_in_period"), "patron_id", "start_month"))


def consecutive_month_starts(t: Tables) -> DataFrame:
    """Q-24 before its HAVING: (patron, start month, 1, loans from that month on)."""
    ml = patron_months(t)
    prev = ml.select(F.col("patron_id").alias("pp"), F.col("loan_month").alias("pm"))
    later = Window.partitionBy("patron_id").orderBy("loan_month").rowsBetween(0, Window.unboundedFollowing)
    with_tail = ml.withColumn("tail_loans", F.sum("loans_in_month").over(later))
    starts = (with_tail.join(prev, (with_tail.patron_id == prev.pp) & (prev.pm == previous_month_key(with_tail.loan_month)),
                             "left_anti")
              .groupBy("patron_id", F.col("loan_month").alias("start_month"))
              .agg(F.count(F.lit(1)).alias("consecutive_months"),
                   F.first("tail_loans").alias("total_loans_in_period")))
    return starts


def q24_streaks_intent(t: Tables, min_months: int = 3) -> DataFrame:
    """Stated intent: runs of >= ``min_months`` consecutive calendar months with loans (gaps and islands).

    The window is per patron over that patron's distinct months, so its partitions are bounded by the number
    of calendar months in the data, whatever the number of loans."""
    ml = patron_months(t)
    idx = F.year(F.to_date(F.concat("loan_month", F.lit("-01")))) * 12 + F.month(
        F.to_date(F.concat("loan_month", F.lit("-01"))))
    island = idx - F.row_number().over(Window.partitionBy("patron_id").orderBy("loan_month"))
    runs = (ml.withColumn("island", island).groupBy("patron_id", "island")
            .agg(F.min("loan_month").alias("start_month"), F.count(F.lit(1)).alias("consecutive_months"),
                 F.sum("loans_in_month").alias("total_loans_in_period"))
            .filter(F.col("consecutive_months") >= min_months))
    return (runs.join(_patron_names(t), "patron_id")
            .select("patron_id", "patron_name", "start_month", "consecutive_months", "total_loans_in_period")
            .orderBy(F.desc("consecutive_months"), F.desc("total_loans_in_period"), "patron_id", "start_month"))


def monthly_type_counts(t: Tables) -> DataFrame:
    """(patron_type, loan_month) -> loans; loans are first reduced to (patron, month) before the patron join."""
    pm = t.loan.filter(F.col("loan_ts").isNotNull()).groupBy(
        "patron_id", month_key("loan_ts").alias("loan_month")).agg(F.count(F.lit(1)).alias("n"))
    return pm.join(t.patron.select("patron_id", "patron_type"), "patron_id")


def q25_monthly_by_type(t: Tables) -> DataFrame:
    """Loans per month for Student, Faculty, Staff and Alumni patrons, plus all loans of the month."""
    ty = F.col("patron_type")
    cols = [F.sum(F.when(ty == name, F.col("n")).otherwise(0)).alias(f"{name.lower()}_loans") for name in PIVOT_TYPES]
    return (monthly_type_counts(t).groupBy("loan_month").agg(*cols, F.sum("n").alias("total_loans"))
            .orderBy(F.desc("loan_month")))


def q26_beats_all_older(t: Tables, year: int = 2010) -> DataFrame:
    """Books from ``year`` on whose loan count exceeds that of every older book (vacuously true when there
    are no older books: ``> ALL`` over an empty set)."""
    b = loans_per_book_all(t)
    older_max = b.filter(F.col("pub_year") < year).agg(F.max("loan_count").alias("older_max"))  # one row
    return (b.filter(F.col("pub_year") >= year).crossJoin(older_max)
            .filter(F.col("older_max").isNull() | (F.col("loan_count") > F.col("older_max")))
            .select("isbn", "title", "pub_year", "loan_count").orderBy(F.desc("loan_count"), "isbn"))


def q27_borrowed_by_both(t: Tables, type_a: str = "Student", type_b: str = "Faculty") -> DataFrame:
    """Books loaned by at least one patron of ``type_a`` and at least one of ``type_b``."""
    # loans are reduced to one row per copy (which of the two types borrowed it) before meeting the books
    per_copy = (t.loan.select("copy_id", "patron_id").distinct()
                .join(t.patron.filter(F.col("patron_type").isin(type_a, type_b)).select("patron_id", "patron_type"),
                      "patron_id")
                .groupBy("copy_id").agg(F.max((F.col("patron_type") == type_a).cast("int")).alias("a"),
                                        F.max((F.col("patron_type") == type_b).cast("int")).alias("b")))
    both = (per_copy.join(t.copy.select("copy_id", "isbn"), "copy_id")
            .groupBy("isbn").agg(F.max("a").alias("a"), F.max("b").alias("b"))
            .filter((F.col("a") == 1) & (F.col("b") == 1)))
    return (t.book.select("isbn", "title").join(both, "isbn", "left_semi").orderBy("title", "isbn"))


def book_loan_span(t: Tables) -> DataFrame:
    """Per book with loans: total loans, first and last loan timestamp (aggregate form)."""
    per_copy = t.loan.groupBy("copy_id").agg(F.count("loan_id").alias("n"), F.min("loan_ts").alias("lo"),
                                             F.max("loan_ts").alias("hi"))
    return (per_copy.join(t.copy.select("copy_id", "isbn"), "copy_id")
            .groupBy("isbn").agg(F.sum("n").alias("total_loans"), F.min("lo").alias("first_loan_date"),
                                 F.max("hi").alias("last_loan_date")))


def book_loan_values(t: Tables) -> DataFrame:
    """COUNT OVER, FIRST_VALUE and LAST_VALUE over a book's loans (full frame, by loan time), one row per book (W-09,
    W-10). A frame's ends lie among the first and last loans of the book's copies, so the loans are reduced per copy
    before the copies meet their books, and the window holds two rows per copy, however many loans a book has. NULL
    times come first in the frame's order, so a book with one has a NULL first value."""
    none_first = F.struct(F.col("loan_ts").isNotNull().alias("known"), F.col("loan_ts").alias("ts"))
    per_copy = t.loan.groupBy("copy_id").agg(F.count("loan_id").alias("n"), F.min(none_first).alias("lo"),
                                             F.max(none_first).alias("hi"))
    ends = F.explode(F.array(F.struct(F.col("lo.ts").alias("ts"), F.col("n").alias("n")),
                             F.struct(F.col("hi.ts").alias("ts"), F.lit(0).cast("bigint").alias("n")))).alias("e")
    rows = per_copy.join(t.copy.select("copy_id", "isbn"), "copy_id").join(t.book.select("isbn"), "isbn", "left_semi").select(
        "isbn", ends).select("isbn", "e.*")
    w = Window.partitionBy("isbn").orderBy(F.asc_nulls_first("ts")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("isbn", F.sum("n").over(w).alias("total_loans"), F.first("ts").over(w).alias("first_loan_date"),
                       F.last("ts").over(w).alias("last_loan_date")).distinct()


def q28_first_last_loan(t: Tables, k: int = 20) -> DataFrame:
    """The ``k`` books with most loans (more than one): count, first and last loan and the days between."""
    return (book_loan_span(t).filter(F.col("total_loans") > 1)
            .join(t.book.select("isbn", "title"), "isbn")
            .select("isbn", "title", "total_loans", "first_loan_date", "last_loan_date",
                    days_between("last_loan_date", "first_loan_date").alias("days_between_first_last"))
            .orderBy(F.desc("total_loans"), "isbn").limit(k))


def q29_rollup_type_year(t: Tables, as_of=None) -> DataFrame:
    """ROLLUP(patron_type, year): distinct patrons, loans and average duration per level.

    Loans are first reduced to one row per (patron, year) with their count and duration sum, then meet the patron's
    type; the rollup (which expands its input once per grouping level) runs over those rows only. The average is
    recombined from the sums exactly."""
    per = (t.loan.groupBy("patron_id", year_key("loan_ts").alias("yr"))
           .agg(F.count("loan_id").alias("n"), F.sum(loan_duration(as_of)).alias("sd"))
           .join(t.patron.select("patron_id", "patron_type"), "patron_id"))
    return (per.rollup("patron_type", "yr").agg(
        F.countDistinct("patron_id").alias("unique_patrons"), F.sum("n").alias("total_loans"),
        exact_avg_from_sums(F.sum("sd"), F.sum("n")).alias("avg_duration_days"),
        F.grouping("patron_type").alias("g_type"), F.grouping("yr").alias("g_year"))
        .select(F.when(F.col("g_type") == 1, "ALL TYPES").otherwise(F.col("patron_type")).alias("patron_type"),
                F.when(F.col("g_year") == 1, "ALL YEARS").otherwise(F.col("yr")).alias("loan_year"),
                "unique_patrons", F.col("total_loans").cast("bigint").alias("total_loans"), "avg_duration_days")
        .orderBy("patron_type", "loan_year"))


def q30_coauthors(t: Tables, min_books: int = 2) -> DataFrame:
    """Author pairs (smaller id first) sharing at least ``min_books`` books, counted exactly by
    ``pairs.shared_item_pairs``."""
    from lendwise.operators.pairs import shared_item_pairs
    # the books are joined where their links are, not collected: the planner takes a table of a few MB of Parquet for small
    links = (t.bookauthor.join(t.book.select("isbn").hint("shuffle_hash"), "isbn", "left_semi")
             .join(t.author.select("author_id"), "author_id", "left_semi"))
    pairs = shared_item_pairs(links, member="author_id", item="isbn", min_shared=min_books, tasks=t.tasks)
    a1 = t.author.select(F.col("author_id").alias("author1_id"), full_name().alias("author1_name"))
    a2 = t.author.select(F.col("author_id").alias("author2_id"), full_name().alias("author2_name"))
    return (pairs.withColumnRenamed("member1", "author1_id").withColumnRenamed("member2", "author2_id")
            .join(a1, "author1_id").join(a2, "author2_id")
            .select("author1_id", "author1_name", "author2_id", "author2_name",
                    F.col("shared").alias("books_together"))
            .orderBy(F.desc("books_together"), "author1_name", "author2_name", "author1_id", "author2_id"))
