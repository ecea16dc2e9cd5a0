"""The parameterized reports as SQL table functions (P-07), over the library's tables registered as temp views.

``register_reports`` makes D-02 ... D-05 callable from ``spark.sql``, with the parameters that the reports' SQL takes; a
NULL or missing parameter means 'no filter', a missing date means today:

    SELECT * FROM overdue_risk(DATE'2001-08-02') WHERE risk_rank <= 10
    SELECT * FROM book_catalog(search => 'gear')
    SELECT * FROM patron_risk_profile()
    SET VAR report_as_of = DATE'2001-08-02'; SELECT * FROM loans_segmented(report_as_of, 'OVERDUE')

They are plain SQL, planned with the rest of the statement that calls them, so filters and column choices reach the
scans. Ranks are computed over distinct scores (or within a subject) by a window; the operators in ``reports`` rank
without a window partition and are the form for very large results.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lendwise.operators import views as V
from lendwise.sources.tables import Tables

_OVERDUE_RISK = """
CREATE OR REPLACE TEMPORARY FUNCTION overdue_risk(as_of DATE DEFAULT CURRENT_DATE())
RETURNS TABLE (loan_id BIGINT, patron_name STRING, book_title STRING, due_date DATE, days_overdue INT, all_loans BIGINT,
  overdue_or_late_loans BIGINT, unpaid_fines DECIMAL(18,2), risk_score DECIMAL(20,6), risk_rank INT)
RETURN
WITH history AS (
  SELECT patron_id, count(loan_id) AS all_loans, count_if(late) AS overdue_or_late_loans
  FROM (SELECT patron_id, loan_id, (return_ts IS NULL AND due_ts < overdue_risk.as_of) OR return_ts > due_ts AS late FROM loan)
  GROUP BY patron_id),
owed AS (SELECT patron_id, CAST(sum(CASE WHEN status = 'Unpaid' THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS unpaid_fines
         FROM fine GROUP BY patron_id),
late AS (
  SELECT l.loan_id, concat(p.first_name, ' ', p.last_name) AS patron_name, b.title AS book_title, CAST(l.due_ts AS DATE) AS due_date,
         datediff(overdue_risk.as_of, CAST(l.due_ts AS DATE)) AS days_overdue, h.all_loans, h.overdue_or_late_loans, o.unpaid_fines
  FROM loan l JOIN patron p ON p.patron_id = l.patron_id JOIN copy c ON c.copy_id = l.copy_id JOIN book b ON b.isbn = c.isbn
  LEFT JOIN history h ON h.patron_id = l.patron_id LEFT JOIN owed o ON o.patron_id = l.patron_id
  WHERE l.return_ts IS NULL AND l.due_ts < overdue_risk.as_of),
scored AS (SELECT *, CAST(days_overdue + 2 * overdue_or_late_loans + unpaid_fines / 10.0 AS DECIMAL(20,6)) AS risk_score FROM late),
place AS (SELECT risk_score AS s, CAST(1 + coalesce(sum(n) OVER (
            ORDER BY risk_score DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS risk_rank
          FROM (SELECT risk_score, count(*) AS n FROM scored GROUP BY risk_score))
SELECT scored.*, risk_rank FROM scored JOIN place ON scored.risk_score <=> place.s
"""

_BOOK_CATALOG = """
CREATE OR REPLACE TEMPORARY FUNCTION book_catalog(search STRING DEFAULT NULL, subject_id BIGINT DEFAULT NULL)
RETURNS TABLE (isbn STRING, title STRING, pub_year INT, publisher_name STRING, authors STRING, subjects STRING,
  times_loaned BIGINT, total_copies BIGINT, available_copies BIGINT, primary_subject STRING, subject_popularity_rank INT)
RETURN
WITH used AS (SELECT copy_id, count(loan_id) AS n, count_if(return_ts IS NULL) AS o FROM loan GROUP BY copy_id),
shelf AS (SELECT c.isbn, coalesce(sum(u.n), 0) AS times_loaned, count(c.copy_id) AS total_copies,
                 count_if(coalesce(u.o, 0) = 0) AS available_copies
          FROM copy c LEFT JOIN used u ON u.copy_id = c.copy_id GROUP BY c.isbn),
main AS (SELECT bs.isbn, min(bs.subject_id) AS main_id FROM booksubject bs GROUP BY bs.isbn),
found AS (
  SELECT d.isbn, d.title, d.pub_year, d.publisher_name, d.authors, d.subjects, m.main_id,
         coalesce(s.times_loaned, 0) AS times_loaned, coalesce(s.total_copies, 0) AS total_copies,
         coalesce(s.available_copies, 1) AS available_copies
  FROM vw_book_details d LEFT JOIN main m ON m.isbn = d.isbn LEFT JOIN shelf s ON s.isbn = d.isbn
  WHERE (coalesce(book_catalog.search, '') = '' OR d.title ILIKE concat('%', book_catalog.search, '%')
         OR d.isbn ILIKE concat('%', book_catalog.search, '%'))
    AND (book_catalog.subject_id IS NULL OR m.main_id = book_catalog.subject_id))
SELECT f.isbn, f.title, f.pub_year, f.publisher_name, f.authors, f.subjects, f.times_loaned, f.total_copies, f.available_copies,
       s.name AS primary_subject, CAST(rank() OVER (PARTITION BY f.main_id ORDER BY f.times_loaned DESC, f.title) AS INT)
FROM found f LEFT JOIN subject s ON s.subject_id = f.main_id
"""

_PATRON_RISK = """
CREATE OR REPLACE TEMPORARY FUNCTION patron_risk_profile(as_of DATE DEFAULT CURRENT_DATE())
RETURNS TABLE (patron_id BIGINT, patron_name STRING, email STRING, patron_type STRING, balance DECIMAL(8,2), total_loans BIGINT,
  active_loans BIGINT, overdue_loans BIGINT, last_loan_ts TIMESTAMP_NTZ, total_fines DECIMAL(18,2), unpaid_fines DECIMAL(18,2),
  risk_level STRING, is_recent_borrower INT)
RETURN
WITH used AS (
  SELECT patron_id, count(loan_id) AS n, count_if(return_ts IS NULL) AS o,
         count_if(overdue) AS late, max(loan_ts) AS last_loan_ts
  FROM (SELECT *, return_ts IS NULL AND due_ts < patron_risk_profile.as_of AS overdue FROM loan) GROUP BY patron_id),
p AS (
  SELECT p.patron_id, concat(p.first_name, ' ', p.last_name) AS patron_name, p.email, p.patron_type, p.balance,
         coalesce(u.n, 0) AS total_loans, coalesce(u.o, 1) AS active_loans, coalesce(u.late, 0) AS overdue_loans, u.last_loan_ts,
         f.total_fines, f.unpaid_fines
  FROM patron p LEFT JOIN used u ON u.patron_id = p.patron_id JOIN vw_patron_fines_summary f ON f.patron_id = p.patron_id)
SELECT *, CASE WHEN unpaid_fines >= 50 OR overdue_loans >= 3 THEN 'HIGH'
               WHEN unpaid_fines BETWEEN 10 AND 49 OR overdue_loans BETWEEN 1 AND 2 THEN 'MEDIUM' ELSE 'LOW' END,
       CAST(coalesce(CAST(last_loan_ts AS DATE) >= date_sub(patron_risk_profile.as_of, 30), false) AS INT)
FROM p
"""

_LOANS_SEGMENTED = """
CREATE OR REPLACE TEMPORARY FUNCTION loans_segmented(as_of DATE DEFAULT CURRENT_DATE(), status STRING DEFAULT NULL)
RETURNS TABLE (loan_id BIGINT, patron_name STRING, barcode STRING, isbn STRING, title STRING, branch_name STRING,
  loan_ts TIMESTAMP_NTZ, due_ts TIMESTAMP_NTZ, return_ts TIMESTAMP_NTZ, status STRING, duration_days INT,
  avg_duration_per_patron DECIMAL(24,4), duration_vs_usual STRING)
RETURN
WITH rows AS (
  SELECT l.*, c.barcode, c.isbn, b.title, br.name AS branch_name,
         CASE WHEN return_ts IS NOT NULL THEN 'RETURNED' WHEN due_ts < loans_segmented.as_of THEN 'OVERDUE' ELSE 'CURRENT' END AS state,
         datediff(coalesce(CAST(return_ts AS DATE), loans_segmented.as_of), CAST(loan_ts AS DATE)) AS duration_days
  FROM loan l JOIN copy c ON c.copy_id = l.copy_id JOIN book b ON b.isbn = c.isbn JOIN branch br ON br.branch_id = c.branch_id),
usual AS (SELECT patron_id, avg(CAST(duration_days AS DECIMAL(20,0))) AS usual FROM rows GROUP BY patron_id)
SELECT r.loan_id, concat(p.first_name, ' ', p.last_name), r.barcode, r.isbn, r.title, r.branch_name, r.loan_ts, r.due_ts,
       r.return_ts, r.state, r.duration_days, u.usual,
       CASE WHEN r.duration_days > u.usual THEN 'LONGER THAN USUAL' WHEN r.duration_days < u.usual THEN 'SHORTER THAN USUAL'
            ELSE 'TYPICAL' END
FROM rows r JOIN patron p ON p.patron_id = r.patron_id LEFT JOIN usual u ON u.patron_id <=> r.patron_id
WHERE upper(coalesce(loans_segmented.status, 'ALL')) NOT IN ('CURRENT', 'OVERDUE', 'RETURNED')
   OR r.state = upper(loans_segmented.status)
"""

# tables that grow with the library: joined by shuffles, never collected
GROWING = ("book", "booksubject", "copy", "fine", "loan", "patron")

FUNCTIONS = {"overdue_risk": _OVERDUE_RISK, "book_catalog": _BOOK_CATALOG, "patron_risk_profile": _PATRON_RISK,
             "loans_segmented": _LOANS_SEGMENTED}


def register_reports(t: Tables) -> SparkSession:
    """Registers the tables, the views that need no date, the report functions and the variable ``report_as_of``."""
    spark = t.loan.sparkSession
    # the planner takes a table of a few MB of Parquet for small and would collect its rows on the driver to broadcast them
    t.replace(**{name: t[name].hint("merge") for name in GROWING}).register_views()
    for name, view in (("vw_book_details", V.v01_book_details), ("vw_patron_fines_summary", V.v04_patron_fines_summary)):
        view(t).createOrReplaceTempView(name)
    for statement in FUNCTIONS.values():
        spark.sql(statement)
    spark.sql("DECLARE OR REPLACE VARIABLE report_as_of DATE DEFAULT CURRENT_DATE()")
    return spark
