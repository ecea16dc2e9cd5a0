"""Each language-level primitive of SURVEY §2.6-2.9 is exercised by a registered key; where the primitive has a
physical-plan signature, the key's plan must show it."""

import pytest

from lendwise.catalog import REGISTRY
from lendwise.plans import physical_plan

PRIMITIVES = {
    "P-01 projection": ("v03_patron_contact", "Project"),
    "P-03 IS NULL": ("v05_current_loans", "isnull"),
    "P-04 IN list": ("q16_reserved_never_borrowed", " IN ("),
    "P-05 BETWEEN": ("q15_popularity_buckets", "<= 5"),
    "P-06 LIKE (case-insensitive)": ("d03_book_catalog_search", "Contains(lower("),
    "P-08 searched CASE": ("v07_patron_loans_with_status", "CASE WHEN"),
    "P-09 CASE in ORDER BY": ("q15_popularity_buckets", "CASE WHEN (popularity_category"),
    "P-11 decimal arithmetic": ("d02_overdue_risk", "risk_score"),
    "P-12 constants": ("q18_action_items", "Overdue Loan"),
    "J-01 inner join": ("v05_current_loans", "Inner"),
    "J-02 left outer join": ("v03_patron_contact", "LeftOuter"),
    "J-03 left join after right-side filter": ("d03_book_catalog", "LeftOuter"),
    "J-04 cross join of one row": ("q11_above_avg_copies", "NestedLoopJoin"),
    "J-05 USING join": ("q12_fine_rank", "Join"),
    "J-06 self join with theta": ("q30_coauthors", "(x#"),
    "J-07 equi + range join (as a suffix sum over months)": ("q24_consecutive_months", "tail_loans"),
    "J-08 semi join": ("q27_borrowed_by_both", "LeftSemi"),
    "J-09 anti join": ("q17_never_loaned_copies", "LeftAnti"),
    "J-10 anti join on computed key": ("q24_consecutive_months", "LeftAnti"),
    "J-11 anti join with outer-join subquery": ("q18_action_items", "LeftAnti"),
    "J-12 bridge join": ("q02_books_in_subject", "Inner"),
    "G-01 COUNT(*)": ("v08_copy_inventory_by_branch", "count(1)"),
    "G-02 COUNT(col)": ("v09_eresource_usage_summary", "count(session_id"),
    "G-03 COUNT(DISTINCT)": ("v09_eresource_usage_summary", "count(distinct"),
    "G-04 SUM/AVG/MIN/MAX": ("q23_fine_analysis", "avg("),
    "G-05 conditional SUM": ("q25_monthly_by_type", "CASE WHEN"),
    "G-06 global aggregate": ("a01_total_unpaid", "HashAggregate(keys=[]"),
    "G-07 multi-key group": ("q29_rollup_type_year", "HashAggregate(keys=[patron_type"),
    "G-08 HAVING": ("q19_repeat_borrowers", "times_borrowed"),
    "G-09 two-level aggregation": ("q14_multi_branch_patrons", "HashAggregate"),
    "G-10 ROLLUP": ("q29_rollup_type_year", "Expand"),
    "G-11 ordered distinct concat": ("v01_book_details", "collect_set"),
    "G-12 pivot by conditional sums": ("q25_monthly_by_type", "student_loans"),
    "G-13 DISTINCT": ("a02_subject_list", "HashAggregate"),
    "W-01 ROW_NUMBER": ("q24_streaks_intent", "row_number"),
    "W-02 RANK partitioned": ("d03_book_catalog", "Window"),
    "W-03 DENSE_RANK": ("q12_fine_rank", "Window"),
    "W-04 RANK global (distributed)": ("d02_overdue_risk", "Window"),
    "W-05 LAG (distributed: join on position - 1)": ("q13_duration_lag", "_l_pos"),
    "W-06 LAG on an aggregate": ("q21_monthly_running", "lag("),
    "W-07 running SUM": ("d06_monthly_trends", "sum(total_loans"),
    "W-08 whole-set SUM": ("q21_monthly_running", "all_loans"),
    "W-09 FIRST/LAST_VALUE": ("w09_first_last_value", "last("),
    "W-10 COUNT OVER": ("w09_first_last_value", "count(loan_id"),
    "W-11 window over grouped aggregate": ("q21_monthly_running", "Window"),
    "O-01 multi-key ORDER BY": ("q05_patron_fines", "Sort"),
    "O-03 top-k": ("q09_top_patrons", "TakeOrderedAndProject"),
    "U-01 UNION ALL": ("q18_action_items", "Union"),
    "U-02 INTERSECT emulation": ("q27_borrowed_by_both", "LeftSemi"),
    "U-03 set difference": ("q16_reserved_never_borrowed", "LeftAnti"),
    "B-01 scalar subquery": ("q20_slow_branches", "overall_avg_duration"),
    "B-02 > ALL": ("q26_beats_all_older", "older_max"),
    "B-05 correlated EXISTS": ("q16_reserved_never_borrowed", "LeftAnti"),
}


@pytest.mark.parametrize("name", list(PRIMITIVES))
def test_primitive_in_plan(projected, name):
    key, needle = PRIMITIVES[name]
    assert key in REGISTRY
    assert needle in physical_plan(REGISTRY[key](projected)), f"{name}: {needle!r} not in plan of {key}"
