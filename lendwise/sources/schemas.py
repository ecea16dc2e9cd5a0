"""Schemas of the 22 library tables plus their declared constraints.

One declaration per table drives the typed loaders (sources.tables), the data-quality jobs
(operators.quality) and the test fixtures. Identifiers are 64-bit because the driver data uses int64 keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

ID = T.LongType()
INT = T.IntegerType()
STR = T.StringType()
DATE = T.DateType()
TS = T.TimestampNTZType()  # wall-clock date-times, independent of the session time zone
MONEY = T.DecimalType(8, 2)


@dataclass(frozen=True)
class Col:
    name: str
    dtype: T.DataType
    nullable: bool = False
    max_len: int | None = None  # VARCHAR(n) / CHAR(n) length


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[Col, ...]
    pk: tuple[str, ...]
    unique: tuple[str, ...] = ()
    fks: tuple[tuple[str, str, str], ...] = ()  # (child column, parent table, parent column)
    defaults: dict = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.dtype, c.nullable) for c in self.columns])

    @property
    def not_null(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns if not c.nullable)

    def col(self, name: str) -> Col:
        return next(c for c in self.columns if c.name == name)


def _t(name, cols, pk, unique=(), fks=(), defaults=None):
    return TableSpec(name, tuple(cols), tuple(pk), tuple(unique), tuple(fks), defaults or {})


# The tables' columns, lengths, keys, references and defaults.
TABLES: dict[str, TableSpec] = {t.name: t for t in [
    _t("address", [Col("address_id", ID), Col("street", STR, False, 120), Col("city", STR, False, 80),
                   Col("state", STR, True, 40), Col("postal_code", STR, True, 20), Col("country", STR, False, 80)],
       ["address_id"]),
    _t("publisher", [Col("publisher_id", ID), Col("name", STR, False, 120), Col("address_id", ID, True)],
       ["publisher_id"], ["name"], [("address_id", "address", "address_id")]),
    _t("author", [Col("author_id", ID), Col("first_name", STR, False, 80), Col("last_name", STR, False, 80)],
       ["author_id"]),
    _t("subject", [Col("subject_id", ID), Col("name", STR, False, 80)], ["subject_id"], ["name"]),
    _t("term", [Col("term_id", ID), Col("name", STR, False, 20), Col("year", INT),
                Col("start_date", DATE, True), Col("end_date", DATE, True)], ["term_id"]),
    _t("finereason", [Col("reason_id", ID), Col("code", STR, False, 40), Col("description", STR, True, 200)],
       ["reason_id"], ["code"]),
    _t("provider", [Col("provider_id", ID), Col("name", STR, False, 120), Col("contact_email", STR, True, 120),
                    Col("address_id", ID, True)],
       ["provider_id"], ["name"], [("address_id", "address", "address_id")]),
    _t("license", [Col("license_id", ID), Col("provider_id", ID), Col("start_date", DATE), Col("end_date", DATE),
                   Col("concurrent_limit", INT)],
       ["license_id"], (), [("provider_id", "provider", "provider_id")]),
    _t("resourcetype", [Col("resource_type_id", ID), Col("name", STR, False, 20)], ["resource_type_id"], ["name"]),
    _t("partnerlibrary", [Col("partner_id", ID), Col("name", STR, False, 150), Col("address_id", ID, True)],
       ["partner_id"], ["name"], [("address_id", "address", "address_id")]),
    _t("branch", [Col("branch_id", ID), Col("name", STR, False, 100), Col("address_id", ID)],
       ["branch_id"], ["name"], [("address_id", "address", "address_id")]),
    _t("book", [Col("isbn", STR, False, 13), Col("title", STR, False, 200), Col("publisher_id", ID, True),
                Col("pub_year", INT, True)],
       ["isbn"], (), [("publisher_id", "publisher", "publisher_id")]),
    _t("booksubject", [Col("isbn", STR, False, 13), Col("subject_id", ID)], ["isbn", "subject_id"], (),
       [("isbn", "book", "isbn"), ("subject_id", "subject", "subject_id")]),
    _t("bookauthor", [Col("isbn", STR, False, 13), Col("author_id", ID)], ["isbn", "author_id"], (),
       [("isbn", "book", "isbn"), ("author_id", "author", "author_id")]),
    _t("copy", [Col("copy_id", ID), Col("isbn", STR, False, 13), Col("branch_id", ID),
                Col("checkin_term_id", ID, True), Col("barcode", STR, True, 40)],
       ["copy_id"], ["barcode"],
       [("isbn", "book", "isbn"), ("branch_id", "branch", "branch_id"), ("checkin_term_id", "term", "term_id")]),
    _t("patron", [Col("patron_id", ID), Col("first_name", STR, False, 80), Col("last_name", STR, False, 80),
                  Col("email", STR, True, 120), Col("patron_type", STR, False, 20), Col("address_id", ID, True),
                  Col("balance", MONEY)],
       ["patron_id"], ["email"], [("address_id", "address", "address_id")], {"balance": "0.00"}),
    _t("loan", [Col("loan_id", ID), Col("copy_id", ID), Col("patron_id", ID), Col("loan_ts", TS),
                Col("due_ts", TS), Col("return_ts", TS, True)],
       ["loan_id"], (), [("copy_id", "copy", "copy_id"), ("patron_id", "patron", "patron_id")]),
    _t("fine", [Col("fine_id", ID), Col("loan_id", ID), Col("patron_id", ID), Col("reason_id", ID),
                Col("amount", MONEY), Col("status", STR, False, 20), Col("created_at", TS)],
       ["fine_id"], (),
       [("loan_id", "loan", "loan_id"), ("patron_id", "patron", "patron_id"),
        ("reason_id", "finereason", "reason_id")], {"created_at": "now"}),
    _t("reservation", [Col("reservation_id", ID), Col("patron_id", ID), Col("isbn", STR, False, 13),
                       Col("branch_id", ID), Col("created_at", TS), Col("status", STR, False, 20)],
       ["reservation_id"], (),
       [("patron_id", "patron", "patron_id"), ("isbn", "book", "isbn"), ("branch_id", "branch", "branch_id")],
       {"created_at": "now"}),
    _t("eresource", [Col("resource_id", ID), Col("title", STR, False, 200), Col("resource_type_id", ID),
                     Col("license_id", ID)],
       ["resource_id"], (),
       [("resource_type_id", "resourcetype", "resource_type_id"), ("license_id", "license", "license_id")]),
    _t("accesssession", [Col("session_id", ID), Col("patron_id", ID), Col("resource_id", ID),
                         Col("start_time", TS), Col("end_time", TS, True)],
       ["session_id"], (), [("patron_id", "patron", "patron_id"), ("resource_id", "eresource", "resource_id")]),
    _t("illrequest", [Col("request_id", ID), Col("patron_id", ID), Col("partner_id", ID), Col("isbn", STR, False, 13),
                      Col("status", STR, False, 20), Col("requested_at", TS)],
       ["request_id"], (),
       [("patron_id", "patron", "patron_id"), ("partner_id", "partnerlibrary", "partner_id"),
        ("isbn", "book", "isbn")], {"requested_at": "now"}),
]}

TABLE_NAMES = tuple(TABLES)

# Fixed vocabularies stated by the reference's rules (fixed values).
FINE_STATUSES_ALLOWED = ("Paid", "Unpaid", "Pending", "Waived")
RESERVATION_INACTIVE = ("Fulfilled", "Cancelled")
RESERVATION_OPEN = ("Active", "Waiting")
PATRON_TYPES = ("Student", "Faculty", "Staff", "Alumni", "Guest")
PIVOT_TYPES = ("Student", "Faculty", "Staff", "Alumni")
