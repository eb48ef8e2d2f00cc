"""Small hand-made records used across the tests."""

from __future__ import annotations

from casegate.sources.export import RECORD_COLUMNS

HEADER = (
    "CASE_REF,ISN,APPLICANT_USER_ID,APPLICANT_NAME,PERMIT_CATEGORY,FEE_AMOUNT,LAST_UPDATED,FEE_PAID,"
    "VT_1_DATE,VT_1_RESULT,VT_2_DATE,VT_2_RESULT,VT_3_DATE,VT_3_RESULT,RESTR_1,RESTR_2,RESTR_3,"
    "ISSUED,EXPIRED,DATE_COMPLETED"
)

RECORD_SCHEMA = (
    "part int, source_line bigint, source_hash string, case_ref string, isn string, "
    "applicant_user_id string, applicant_name string, permit_category string, fee_amount string, "
    "last_updated string, fee_paid string, "
    "attempts array<struct<occurrence:int,date:string,result:string>>, restrictions array<string>, "
    "issued string, expired string, date_completed string"
)


def record(line: int = 2, **changes):
    """A valid record with some fields changed."""
    values = {
        "part": 0,
        "source_line": line,
        "source_hash": f"sha256:{line}",
        "case_ref": f"T-{line}",
        "isn": str(line),
        "applicant_user_id": "U.ONE",
        "applicant_name": "One Person",
        "permit_category": "B",
        "fee_amount": "10.00",
        "last_updated": "2026-08-01",
        "fee_paid": "FALSE",
        "attempts": [],
        "restrictions": [],
        "issued": "",
        "expired": "",
        "date_completed": "",
    }
    assert changes.keys() <= values.keys()
    values.update(changes)
    return tuple(values[c] for c in RECORD_COLUMNS)


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def line(**fields) -> str:
    """One export line; fields by column name, the rest blank."""
    return ",".join(fields.get(name, "") for name in HEADER.split(","))


def person(ref: str, updated: str, paid: str, category: str = "B", **more) -> str:
    base = dict(
        CASE_REF=ref,
        ISN="77",
        APPLICANT_USER_ID=f"U.{ref[-2:] or 'XX'}",
        APPLICANT_NAME="Some Body",
        PERMIT_CATEGORY=category,
        FEE_AMOUNT="31.50",
        LAST_UPDATED=updated,
        FEE_PAID=paid,
    )
    return line(**base, **more)


# Thirteen cases, one per path through the rules, with what must become of them.
GOLDEN = [
    (person("G-01", "2026-07-30", "FALSE"), "MIGRATE", "vision-assessment", None),
    (
        person("G-02", "2026-06-09", "FALSE", VT_1_DATE="2026-05-03", VT_1_RESULT="FAIL",
               VT_2_DATE="2026-06-09", VT_2_RESULT="PASS", RESTR_1="B"),
        "MIGRATE", "cashier-fee-review", None,
    ),
    (
        person("G-03", "2026-07-04", "TRUE", "C", VT_1_DATE="2026-07-02", VT_1_RESULT="PASS"),
        "MIGRATE", "issuing-review", None,
    ),
    (
        person("G-04", "2026-04-21", "TRUE", VT_1_DATE="2026-03-29", VT_1_RESULT="PASS",
               ISSUED="2026-04-19", EXPIRED="2031-04-19", DATE_COMPLETED="2026-04-21"),
        "SKIP", None, "COMPLETED",
    ),
    (person("G-05", "2026-01-11", "TRUE", ISSUED="2026-01-11"), "SKIP", None, "LIVE_PERMIT"),
    (
        person("G-06", "2021-03-05", "TRUE", ISSUED="2021-03-05", EXPIRED="2024-03-05"),
        "SKIP", None, "EXPIRED_HISTORICAL",
    ),
    (
        person("G-07", "2026-05-21", "FALSE", VT_1_DATE="2026-05-21", VT_1_RESULT="FAIL"),
        "SKIP", None, "TERMINATED_VISION_FAIL",
    ),
    (person("G-08", "2025-11-03", "FALSE"), "QUARANTINE", None, "OUT_OF_CUTOFF"),
    (person("G-09", "2026-08-13", "TRUE"), "QUARANTINE", None, "UNMATCHED"),
    (person("G-10", "2026-02-02", "FALSE", EXPIRED="2026-02-02"), "QUARANTINE", None, "PREVALIDATION"),
    (person("G-11", "", "FALSE"), "QUARANTINE", None, "PREVALIDATION"),
    (person("", "2026-08-06", "FALSE"), "QUARANTINE", None, "PREVALIDATION"),
    (
        # The last line is one field short, as exports are.
        person("G-13", "2026-08-21", "TRUE", "", VT_1_DATE="2026-08-15", VT_1_RESULT="PASS")[:-1],
        "QUARANTINE", None, "CONTRACT_UNSATISFIED",
    ),
]
