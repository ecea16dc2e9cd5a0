"""Registry of query keys: key -> function(Tables) -> DataFrame, all pinned to the registered ``as_of``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwise import standins as S
from lendwise import streaming
from lendwise.operators import admission as T
from lendwise.operators import quality as C
from lendwise.operators import queries as Q
from lendwise.operators import reports as R
from lendwise.operators import summaries as M
from lendwise.operators import views as V
from lendwise.operators.quantified import OPERATORS, quantified
from lendwise.operators.reports_sql import register_reports
from lendwise.operators.search import TitleIndex, search_all
from lendwise.session import ensure_checkpoint_dir
from lendwise.sources.projection import AS_OF
from lendwise.sources.script import load_script, write_script
from lendwise.sources.tables import Tables



def _scratch(t: Tables, label: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(t.book.sparkSession)}/{label}-{uuid.uuid4().hex}"


COMPARISONS = [(op, q, f"{name}_{q.lower()}") for op, name in zip(OPERATORS, ("eq", "ne", "lt", "le", "gt", "ge")) for q in ("ALL", "ANY")]


def _through_script(t: Tables, table: str, rows: DataFrame) -> DataFrame:
    """Rows written as a script of INSERT statements and read back."""
    path = _scratch(t, "script")
    write_script(rows, table, path)
    return load_script(rows.sparkSession, table, path)


def _stream(t: Tables, table: str, changes: DataFrame, cuts: list[str], **kwargs) -> DataFrame:
    """Decisions of the streaming admission over change rows in micro-batches: id, op, accepted, reason. The change rows
    are written once, as a stream's source would hold them, and each micro-batch reads its own."""
    path, schema = _scratch(t, "changes"), changes.schema
    changes.write.parquet(path)
    source = changes.sparkSession.read.schema(schema).parquet(path)
    return streaming.replay(S.in_batches(source, cuts), table, _scratch(t, "admission"), **kwargs)


REGISTRY: dict[str, Callable[[Tables], DataFrame]] = {
    "v01_book_details": V.v01_book_details,
    "v02_copy_location": V.v02_copy_location,
    "v03_patron_contact": V.v03_patron_contact,
    "v04_patron_fines_summary": V.v04_patron_fines_summary,
    "v05_current_loans": V.v05_current_loans,
    "v06_overdue_loans": lambda t: V.v06_overdue_loans(t, AS_OF),
    "v07_patron_loans_with_status": lambda t: V.v07_patron_loans_with_status(t, AS_OF),
    "v08_copy_inventory_by_branch": V.v08_copy_inventory_by_branch,
    "v09_eresource_usage_summary": V.v09_eresource_usage_summary,
    "v10_illrequest_detail": V.v10_illrequest_detail,
    "q01_books_full": Q.q01_books_full,
    "q02_books_in_subject": lambda t: Q.q02_books_in_subject(t, "widget"),
    "q03_copies_of_isbn": lambda t: Q.q03_copies_of_isbn(t, "0000000000001"),
    "q04_inventory_by_branch": Q.q04_inventory_by_branch,
    "q05_patron_fines": Q.q05_patron_fines,
    "q06_current_loans": Q.q06_current_loans,
    "q07_overdue_loans": lambda t: Q.q07_overdue_loans(t, AS_OF),
    "q08_loans_with_status": lambda t: Q.q08_loans_with_status(t, AS_OF),
    "q09_top_patrons": lambda t: Q.q09_top_patrons(t, 5),
    "q10_popular_books": Q.q10_popular_books,
    "q11_above_avg_copies": Q.q11_above_avg_copies,
    "q12_fine_rank": Q.q12_fine_rank,
    "q13_duration_lag": lambda t: Q.q13_duration_lag(t, AS_OF),
    "q14_multi_branch_patrons": Q.q14_multi_branch_patrons,
    "q15_popularity_buckets": Q.q15_popularity_buckets,
    "q16_reserved_never_borrowed": Q.q16_reserved_never_borrowed,
    "q17_never_loaned_copies": Q.q17_never_loaned_copies,
    "q18_action_items": lambda t: Q.q18_action_items(t, AS_OF),
    "q18_action_items_intent": lambda t: Q.q18_action_items_intent(t, AS_OF),
    "q19_repeat_borrowers": Q.q19_repeat_borrowers,
    "q20_slow_branches": lambda t: Q.q20_slow_branches(t, AS_OF),
    "q21_monthly_running": Q.q21_monthly_running,
    "q22_subject_patterns": Q.q22_subject_patterns,
    "q22_subject_patterns_patron": lambda t: Q.q22_subject_patterns(t, patron_id=10),
    "q22_subject_patterns_top100": lambda t: Q.q22_subject_patterns(t, limit=100),
    "q23_fine_analysis": Q.q23_fine_analysis,
    "q24_consecutive_months": Q.q24_consecutive_months,
    "q24_streaks_intent": Q.q24_streaks_intent,
    "q25_monthly_by_type": Q.q25_monthly_by_type,
    "q26_beats_all_older": lambda t: Q.q26_beats_all_older(t, 1991),
    "q27_borrowed_by_both": Q.q27_borrowed_by_both,
    "q28_first_last_loan": lambda t: Q.q28_first_last_loan(t, 20),
    "q29_rollup_type_year": lambda t: Q.q29_rollup_type_year(t, AS_OF),
    "q30_coauthors": Q.q30_coauthors,
    "d01_dashboard_summary": lambda t: R.d01_dashboard_summary(t, AS_OF),
    "d01_dashboard_summary_intent": lambda t: R.d01_dashboard_summary_intent(t, AS_OF),
    "d02_overdue_risk": lambda t: R.d02_overdue_risk(t, AS_OF),
    "d02_overdue_risk_top10": lambda t: R.d02_overdue_risk_top(t, AS_OF, 10),
    "d03_book_catalog": R.d03_book_catalog,
    "d03_book_catalog_search": lambda t: R.d03_book_catalog(t, search="GEAR"),
    "d03_book_catalog_subject": lambda t: R.d03_book_catalog(t, subject_id=3),
    "d04_patron_risk_profile": lambda t: R.d04_patron_risk_profile(t, AS_OF),
    "d04_patron_risk_route": lambda t: R.d04_patron_risk_route(t, AS_OF),
    "d05_loans_segmented": lambda t: R.d05_loans_segmented(t, AS_OF, "ALL"),
    "d05_loans_overdue": lambda t: R.d05_loans_segmented(t, AS_OF, "OVERDUE"),
    "d05_loans_route": lambda t: R.d05_loans_segmented(t, AS_OF, "ALL", limit=200, with_patron_id=True),
    "d06_monthly_trends": R.d06_monthly_trends,
    "a01_total_unpaid": R.a01_total_unpaid,
    "a02_subject_list": R.a02_subject_list,
    "a03_book_detail": lambda t: R.a03_book_detail(t, "0000000000001"),
    "a04_book_copies": lambda t: R.a04_book_copies(t, "0000000000001"),
    "a05_patron_detail": lambda t: R.a05_patron_detail(t, 1),
    "a06_patron_loan_history": lambda t: R.a06_patron_loan_history(t, AS_OF, 1),
    "a07_patron_fines": lambda t: R.a07_patron_fines(t, 1),
    "a08_open_fines": R.a08_open_fines,
    "a09_top_books": lambda t: R.a09_top_books(t, 10),
    "a10_top_patrons": lambda t: R.a10_top_patrons(t, 10),
    "a11_payment_band": R.a11_payment_band,
    "a12_row_position": lambda t: R.a12_row_position(t, 10),
    "f16_dateformat": R.f16_dateformat,
    "f17_split_subjects": R.f17_split_subjects,
    "f18_money": R.f18_money,
    "c01_pk_violations": lambda t: C.c01_pk_violations(S.with_violations(t)),
    "c02_composite_pk": lambda t: C.c02_composite_pk(S.with_violations(t)),
    "c03_fk_orphans": lambda t: C.c03_fk_orphans(S.with_violations(t)),
    "c03_orphan_keys": lambda t: C.c03_orphan_keys(S.with_violations(t)),
    "c04_unique_violations": lambda t: C.c04_unique_violations(S.with_violations(t)),
    "c05_isbn_length": lambda t: C.c05_isbn_length(S.with_violations(t)),
    "c06_not_null": lambda t: C.c06_not_null(S.with_violations(t)),
    "c07_apply_defaults": lambda t: C.c07_defaults(S.with_violations(t), AS_OF),
    "c08_type_conformance": lambda t: C.c08_type_conformance(S.raw_rows(t)),
    "t01_admit_loans": lambda t: T.t01_admit_loans(S.loan_batch(t), S.split_by_time(t.loan, "loan_ts", S.LOAN_SPLIT)[0]),
    "t02_validate_loan_updates": lambda t: T.t02_validate_loan_updates(S.loans_before_returns(t), S.loan_updates(t)),
    "t03_admit_fines": lambda t: T.t03_admit_fines(S.fine_batch(t), t.loan),
    "t04_admit_reservations": lambda t: T.t04_admit_reservations(
        S.split_by_time(t.reservation, "created_at", S.EVENT_SPLIT)[1],
        S.split_by_time(t.reservation, "created_at", S.EVENT_SPLIT)[0]),
    "t05_admit_sessions": lambda t: T.t05_admit_sessions(
        S.split_by_time(t.accesssession, "start_time", S.SESSION_SPLIT)[1], t.eresource, t.license,
        S.split_by_time(t.accesssession, "start_time", S.SESSION_SPLIT)[0], now=AS_OF),
    "t06_validate_session_updates": lambda t: T.t06_validate_session_updates(S.sessions_before_end(t),
                                                                             S.session_updates(t)),
    "t07_copy_barcode": lambda t: T.t07_copy_barcode(S.copy_batch(t)),
    "t08_patron_type_warning": lambda t: T.t08_patron_type_warning(S.patron_batch(t)),
    "t09_license_insert": lambda t: T.t09_license_insert(S.license_batch(t, 0)),
    "t10_license_update": lambda t: T.t10_license_update(S.license_batch(t, 1)),
    "t11_term_insert": lambda t: T.t11_term_insert(S.term_batch(t, 0)),
    "t12_term_update": lambda t: T.t12_term_update(S.term_batch(t, 1)),
    "t01_loan_stream": lambda t: _stream(t, "loan", S.loan_changes(t), S.LOAN_CUTS),
    "t04_reservation_stream": lambda t: _stream(t, "reservation", S.reservation_changes(t), S.EVENT_CUTS),
    "t05_session_stream": lambda t: _stream(t, "accesssession", S.session_changes(t), S.EVENT_CUTS, now=AS_OF,
                                            eresource=t.eresource, license_=t.license),
    "k02_append_patrons": lambda t: T.k02_append_patrons(t.patron, S.patron_registrations(t), t.address),
    "w09_first_last_value": Q.book_loan_values,
    "j07_loans_from_month": Q.j07_loans_from_month,
    "s25_named_views": lambda t: V.view_counts(t, AS_OF),
    "f14_collated_match": lambda t: R.d03_book_catalog(t, search="WÍDGET", fold=True).select("isbn", "title", "times_loaned"),
    "p06_title_search": lambda t: search_all(
        TitleIndex(_scratch(t, "titles")).write(t.book), t.book.sparkSession, S.NEEDLES),
    "p07_overdue_risk_sql": lambda t: register_reports(t).sql(f"SELECT * FROM overdue_risk(DATE'{AS_OF}')"),
    "p07_book_catalog_sql": lambda t: register_reports(t).sql("SELECT * FROM book_catalog(NULL, NULL)"),
    "p07_book_search_sql": lambda t: register_reports(t).sql("SELECT * FROM book_catalog(search => 'GEAR')"),
    "p07_patron_risk_sql": lambda t: register_reports(t).sql(f"SELECT * FROM patron_risk_profile(DATE'{AS_OF}')"),
    "p07_loans_segmented_sql": lambda t: register_reports(t).sql(f"SELECT * FROM loans_segmented(DATE'{AS_OF}', NULL)"),
    "b02_quantified": lambda t: quantified(S.book_measures(t), "measure", S.older_measures(t).withColumnRenamed("measure", "old"),
                                           "old", COMPARISONS, ["publisher_id"]),
    "s23_insert_script": lambda t: _through_script(t, "patron", S.awkward_patrons(t)),
    "g03_distinct_levels": lambda t: M.g03_distinct_levels(t, _scratch(t, "distinct")),
    "s25_kept_v04": lambda t: M.v04_from_kept(t, M.kept_after(M.kept_fines(_scratch(t, "v04"), 2), [
        M.fine_changes(b) for b in S.signed_batches(t.fine, "fine_id", "status", F.lit("Unpaid"))])),
    "s25_kept_v08": lambda t: M.v08_from_kept(t, M.kept_after(M.kept_inventory(_scratch(t, "v08"), 2), [
        M.copy_changes(b) for b in S.signed_batches(t.copy, "copy_id", "branch_id", (F.col("branch_id") + 1) % 25)])),
    "s25_kept_v09": lambda t: M.v09_from_kept(t, M.kept_after(M.kept_sessions(_scratch(t, "v09"), 2), [
        M.session_changes(b) for b in S.signed_batches(t.accesssession, "session_id", "patron_id", F.col("patron_id") + 1)])),
}


def _document_bound_keys() -> None:
    """Keys bound with fixed arguments (lambdas) take the docstring of the operator they call."""
    modules = (Q, R, V, C, T)
    for fn in REGISTRY.values():
        if fn.__doc__ or fn.__name__ != "<lambda>":
            continue
        for name in fn.__code__.co_names:
            target = next((getattr(m, name) for m in modules if callable(getattr(m, name, None))), None)
            if target is not None and target.__doc__:
                fn.__doc__ = target.__doc__
                break


_document_bound_keys()
