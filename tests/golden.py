"""Small tables with hand-derived results for every kind of check.

Fixed values: rows and expected counts of the published acceptance tables.
"""

from datetime import date, datetime, timedelta
from decimal import Decimal as D

AS_OF = datetime(2026, 1, 15, 12, 0, 0)

COMPLETENESS = (
    "id int, col_null string, col_empty string, col_placeholder string, status string, "
    "col_conditional string, group_key string",
    [
        (1, "Alice", "alice@test.com", "Engineer", "active", "2025-01-01", "A"),
        (2, "Bob", "", "N/A", "active", "2025-02-01", "A"),
        (3, None, "   ", "TBD", "inactive", None, "A"),
        (4, "Diana", "diana@test.com", "Manager", "active", "2025-03-01", "B"),
        (5, "Eve", "eve@test.com", "unknown", "active", None, "B"),
        (6, None, None, None, "inactive", None, "B"),
        (7, "Grace", "grace@test.com", "Analyst", "inactive", "2025-04-01", "C"),
        (8, "Hank", "hank@test.com", "Director", "active", "2025-05-01", "C"),
        (9, "Ivy", "", "-", "active", "2025-06-01", "C"),
        (10, "Jack", "jack@test.com", "VP", "active", "2025-07-01", "C"),
    ],
)

VALIDITY = (
    "id int, priority string, score int, product_code string, amount decimal(10,2), "
    "order_status string, start_value int, end_value int, order_date date, ship_date date, "
    "email string, department string",
    [
        (1, "high", 85, "PRD-1234", D("150"), "shipped", 10, 20, date(2025, 1, 1), date(2025, 1, 5), "alice@corp.com", "Engineering"),
        (2, "medium", 72, "PRD-5678", D("200"), "delivered", 5, 15, date(2025, 2, 1), date(2025, 2, 10), "bob@corp.com", "Sales"),
        (3, "urgent", 90, "PRD-9012", D("300"), "shipped", 1, 10, date(2025, 3, 1), date(2025, 3, 3), "carol@corp.com", "Marketing"),
        (4, "low", 105, "PRD-3456", D("50"), "pending", 20, 30, date(2025, 4, 1), date(2025, 4, 2), "dave@corp.com", "HR"),
        (5, "high", 60, "PRD5678", D("75"), "shipped", 8, 12, date(2025, 5, 1), date(2025, 5, 4), "eve@corp.com", "Finance"),
        (6, "medium", 80, "PRD-7890", D("0"), "shipped", 15, 25, date(2025, 6, 1), date(2025, 6, 5), "frank@corp.com", "Engineering"),
        (7, "high", 55, "PRD-1111", D("120"), "cancelled", 3, 9, date(2025, 7, 1), date(2025, 7, 3), "grace@corp.com", "Sales"),
        (8, "low", 45, "PRD-2222", D("90"), "shipped", 30, 20, date(2025, 8, 1), date(2025, 8, 6), "hank@corp.com", "Marketing"),
        (9, "medium", 78, "PRD-3333", D("110"), "shipped", 2, 8, date(2025, 9, 10), date(2025, 9, 5), "ivy@corp.com", "HR"),
        (10, "high", 92, "PRD-4444", D("250"), "delivered", 12, 18, date(2025, 10, 1), date(2025, 10, 3), "test.user@corp.com", "Finance"),
        (11, "low", 70, "PRD-5555", D("180"), "pending", 6, 14, date(2025, 11, 1), date(2025, 11, 4), "kent@corp.com", "Legal"),
        (12, "medium", -5, "INVALID", D("-10"), "cancelled", 50, 40, date(2025, 12, 15), date(2025, 12, 10), "test.admin@corp.com", "Nonexistent"),
    ],
)
VALIDITY_REF = ("name string", [("Engineering",), ("Sales",), ("Marketing",), ("HR",), ("Finance",)])


def _t(day, hour):
    return datetime(2025, 6, day, hour)


UNIQUENESS = (
    "id int, email string, region string, product string, order_id int, company_name string, "
    "sensor_id string, reading_time timestamp",
    [
        (1, "alice@test.com", "US", "Widget A", 1001, "Acme Corp", "S001", _t(1, 8)),
        (2, "bob@test.com", "US", "Widget B", 1002, "Acme Corporation", "S002", _t(1, 9)),
        (3, "carol@test.com", "EU", "Widget A", 1001, "Beta Inc", "S001", _t(1, 10)),
        (4, "alice@test.com", "EU", "Widget B", 1002, "Beta Incorporated", "S003", _t(1, 11)),
        (5, "dave@test.com", "US", "Widget A", 1003, "Gamma LLC", "S002", _t(1, 12)),
        (6, "eve@test.com", "APAC", "Widget C", 1001, "Delta Ltd", "S004", _t(1, 13)),
        (7, "frank@test.com", "APAC", "Widget A", 1002, "Epsilon Co", "S001", _t(2, 8)),
        (8, "bob@test.com", "EU", "Widget C", 1003, "Acme Corp.", "S005", _t(2, 9)),
        (9, "grace@test.com", "US", "Widget C", 1001, "Zeta Group", "S006", _t(2, 10)),
        (10, "hank@test.com", "EU", "Widget A", 1004, "Eta Partners", "S007", _t(2, 11)),
    ],
)
UNIQUENESS_REF = ("email string", [("alice@test.com",), ("bob@test.com",), ("unique_ref@test.com",)])

CONFORMITY = (
    "id int, email string, phone string, invoice_code string, username string, "
    "first_name string, country_code string, part_number string",
    [
        (1, "alice@example.com", "555-1234", "INV-000001", "alice_w", "Alice", "US", "AB-1234"),
        (2, "bob@company.org", "555-5678", "INV-000002", "bob", "Bob", "UK", "CD-5678"),
        (3, "not-an-email", "555-9012", "INV-000003", "carol_smith", "Carol", "DE", "EF-9012"),
        (4, "dave@test.co", "not-a-phone", "INV-000004", "dave_j", "Dave", "FR", "GH-3456"),
        (5, "eve@example.com", "555-3456", "INV-00005", "ev", "Eve", "JP", "IJ-7890"),
        (6, "frank@example.com", "555-7890", "INV-000006", "frank_miller", "Frank123", "us", "KL-1234"),
        (7, "@invalid", "555-0000", "INV-000007", "grace_h", "Grace", "CA", "M1-5678"),
        (8, "hank@example.com", "(555) 123-4567", "INV-000008", "hank_p", "Hank", "AU", "NO-9012"),
        (9, "ivy@example.com", "555-1111", "INVOICE-09", "ivy_chen", "Ivy", "BR", "PQ-3456"),
        (10, "jack@example.com", "555 2222", "INV-000010", "a]b", "Ja ck", "MX", "RS-7890"),
    ],
)

CONSISTENCY = (
    "id int, status string, tracking_number string, quantity int, unit_price decimal(10,2), "
    "total decimal(10,2), start_date date, end_date date, customer_id int, currency string, "
    "order_group string, line_total decimal(10,2), order_total decimal(10,2)",
    [
        (1, "shipped", "TRK-001", 5, D("10"), D("50"), date(2025, 1, 1), date(2025, 1, 10), 100, "USD", "ORD-A", D("50"), D("150")),
        (2, "shipped", "TRK-002", 3, D("20"), D("60"), date(2025, 2, 1), date(2025, 2, 15), 100, "USD", "ORD-A", D("60"), D("150")),
        (3, "shipped", None, 2, D("15"), D("30"), date(2025, 3, 1), date(2025, 3, 5), 100, "EUR", "ORD-A", D("40"), D("150")),
        (4, "pending", None, 4, D("25"), D("100"), date(2025, 4, 1), date(2025, 4, 20), 200, "GBP", "ORD-B", D("100"), D("250")),
        (5, "shipped", "TRK-005", 1, D("50"), D("55"), date(2025, 5, 1), date(2025, 5, 3), 200, "GBP", "ORD-B", D("50"), D("250")),
        (6, "delivered", None, 10, D("5"), D("50"), date(2025, 6, 1), date(2025, 6, 10), 200, "GBP", "ORD-B", D("100"), D("250")),
        (7, "shipped", "TRK-007", 2, D("30"), D("60"), date(2025, 7, 15), date(2025, 7, 10), 300, "JPY", "ORD-C", D("60"), D("120")),
        (8, "shipped", "TRK-008", 3, D("20"), D("60"), date(2025, 8, 1), date(2025, 8, 10), 300, "JPY", "ORD-C", D("60"), D("120")),
        (9, "cancelled", None, 6, D("10"), D("60"), date(2025, 9, 1), date(2025, 9, 15), 400, "USD", "ORD-D", D("60"), D("60")),
        (10, "shipped", "TRK-010", 8, D("12.5"), D("100"), date(2025, 10, 1), date(2025, 10, 20), 400, "USD", "ORD-D", D("100"), D("160")),
    ],
)
CONSISTENCY_REF = (
    "customer_id int, currency string", [(100, "USD"), (200, "GBP"), (300, "JPY"), (400, "USD")])


def _ago(**kw):
    return AS_OF - timedelta(**kw)


def _row(i, updated, event, load, start, end, hour, minute):
    return (i, updated, event, load, start, end, AS_OF.replace(hour=hour, minute=minute))


_d5, _d6, _d60, _d90 = (_ago(days=n) for n in (5, 6, 60, 90))
TIMELINESS = (
    "id int, updated_at timestamp, event_time timestamp, load_time timestamp, "
    "proc_start timestamp, proc_end timestamp, delivery_time timestamp",
    [
        _row(1, _ago(hours=1), _ago(hours=2), _ago(hours=1), _ago(hours=3), _ago(minutes=170), 7, 30),
        _row(2, _ago(hours=3), _ago(hours=4), _ago(hours=3), _ago(hours=5), _ago(minutes=285), 8, 15),
        _row(3, _ago(hours=12), _ago(hours=14), _ago(hours=12), _ago(hours=15), _ago(minutes=870), 6, 45),
        _row(4, _ago(days=1), _ago(hours=26), _ago(days=1), _ago(hours=27), _ago(minutes=1580), 8, 50),
        _row(5, _ago(days=2), _ago(hours=50), _ago(days=2), _ago(hours=51), _ago(minutes=3010), 5, 30),
        _row(6, _ago(days=3), _ago(hours=72), _ago(days=3), _ago(hours=73), _ago(minutes=4325), 7, 0),
        _row(7, _d5, _d5, _d5 + timedelta(hours=3), _d5, _d5 + timedelta(hours=2), 10, 30),
        _row(8, _d6, _d6, _d6 + timedelta(minutes=30), _d6, _d6 + timedelta(minutes=15), 8, 0),
        _row(9, _d60, _d60, _d60 + timedelta(hours=5), _d60, _d60 + timedelta(hours=3), 4, 0),
        _row(10, _d90, _d90, _d90 + timedelta(hours=48), _d90, _d90 + timedelta(hours=4), 11, 0),
    ],
)

ACCURACY = (
    "id int, employee_id int, name string, salary decimal(10,2), score decimal(10,2), "
    "bonus_rate decimal(5,4), bonus decimal(10,2)",
    [
        (1, 1, "Alice Johnson", D("75000"), D("85"), D("0.1"), D("7500")),
        (2, 2, "Bob Smith", D("82000"), D("78"), D("0.08"), D("6560")),
        (3, 3, "Caroline Williams", D("90000"), D("92"), D("0.12"), D("10800")),
        (4, 4, "Dave Brown", D("64000"), D("70"), D("0.075"), D("4800")),
        (5, 5, "Eve Davis", D("71000"), D("88"), D("0.09"), D("6390")),
        (6, 6, "Franklin Miller", D("85000"), D("75"), D("0.11"), D("9350")),
        (7, 7, "Grace Wilson", D("95000"), D("81"), D("0.1"), D("9500")),
        (8, 8, "Hank Moore", D("78000"), D("83"), D("0.085"), D("6630")),
        (9, 9, "Ivy Chen", D("68000"), D("5"), D("0.07"), D("4760")),
        (10, 10, "Jack Taylor", D("72000"), D("79"), D("0.12"), D("9000")),
    ],
)
ACCURACY_REF = (
    "employee_id int, name string, salary decimal(10,2)",
    [
        (1, "Alice Johnson", D("75000")), (2, "Bob Smith", D("82000")),
        (3, "Carol Williams", D("90000")), (4, "Dave Brown", D("65000")),
        (5, "Eve Davis", D("71000")), (6, "Frank Miller", D("88000")),
        (7, "Grace Wilson", D("95000")), (8, "Hank Moore", D("78000")),
    ],
)

_RECON = "txn_id int, customer string, amount decimal(10,2), quantity int, region string"
RECON_SOURCE = (_RECON, [
    (1001, "Alice", D("100"), 5, "US"), (1002, "Bob", D("200"), 3, "EU"),
    (1003, "Carol", D("150"), 7, "US"), (1004, "Dave", D("300"), 2, "APAC"),
    (1005, "Eve", D("250"), 4, "EU"), (1006, "Frank", D("175"), 6, "US"),
    (1007, "Grace", D("400"), 1, "APAC"), (1008, "Hank", D("125"), 8, "EU"),
    (1009, "Ivy", D("350"), 3, "US"), (1010, "Jack", D("275"), 5, "APAC"),
])
RECON_TARGET = (_RECON, [
    (1001, "Alice", D("100"), 5, "US"), (1002, "Bob", D("200"), 3, "EU"),
    (1003, "Carol", D("155"), 7, "US"), (1004, "Dave", D("300"), 2, "APAC"),
    (1005, "Eve", D("250"), 4, "EU"), (1006, "Frank", D("175"), 6, "US"),
    (1007, "Grace", D("410"), 1, "APAC"), (1008, "Henry", D("125"), 8, "EU"),
    (1009, "Ivy", D("350"), 3, "US"), (1011, "Karen", D("500"), 2, "US"),
])

TABLES = {
    "completeness": COMPLETENESS, "validity": VALIDITY, "validity_ref": VALIDITY_REF,
    "uniqueness": UNIQUENESS, "uniqueness_ref": UNIQUENESS_REF, "conformity": CONFORMITY,
    "consistency": CONSISTENCY, "consistency_ref": CONSISTENCY_REF, "timeliness": TIMELINESS,
    "accuracy": ACCURACY, "accuracy_ref": ACCURACY_REF, "recon_source": RECON_SOURCE,
    "recon_target": RECON_TARGET,
}

_RECON_P = {"source_dataset": "recon_source", "target_dataset": "recon_target"}

# dimension, subtype, columns, params, (total, passed, failed)
EXPECTED = [
    ("completeness", "null", ["col_null"], {}, (10, 8, 2)),
    ("completeness", "population", ["col_null"], {}, (10, 8, 2)),
    ("completeness", "empty", ["col_empty"], {}, (10, 6, 4)),
    ("completeness", "placeholder", ["col_placeholder"],
     {"placeholder_values": ["N/A", "TBD", "unknown", "-"]}, (10, 5, 5)),
    ("completeness", "conditional", ["col_conditional"],
     {"condition_column": "status", "condition_value": "active"}, (7, 6, 1)),
    ("completeness", "multi_field", ["col_null", "col_empty"], {}, (10, 8, 2)),
    ("completeness", "multi_field", ["col_null", "col_empty"],
     {"multi_field_mode": "any"}, (10, 9, 1)),
    ("completeness", "group", ["col_null"], {"group_by_columns": ["group_key"]}, (10, 8, 2)),
    ("validity", "allowed_values", ["priority"],
     {"allowed_values": ["low", "medium", "high"]}, (12, 11, 1)),
    ("validity", "range", ["score"], {"min_value": 0, "max_value": 100}, (12, 10, 2)),
    ("validity", "regex", ["product_code"], {"regex_pattern": "^PRD-[0-9]{4}$"}, (12, 10, 2)),
    ("validity", "cross_field", ["end_value"],
     {"comparison_column": "start_value", "comparison_operator": "gte"}, (12, 10, 2)),
    ("validity", "date_logic", ["ship_date"],
     {"comparison_column": "order_date", "comparison_operator": "after"}, (12, 10, 2)),
    ("validity", "negative", ["email"], {"negative_pattern": "^test.*@"}, (12, 10, 2)),
    ("validity", "reference_lookup", ["department"],
     {"reference_dataset": "validity_ref", "reference_column": "name"}, (12, 10, 2)),
    ("validity", "business_rule", ["amount"],
     {"expression": "amount > 0 AND order_status <> 'cancelled'"}, (12, 9, 3)),
    ("uniqueness", "exact", ["email"], {}, (10, 6, 4)),
    ("uniqueness", "composite", ["region", "product"], {}, (10, 6, 4)),
    ("uniqueness", "scoped", ["order_id"], {"scope_columns": ["region"]}, (10, 8, 2)),
    ("uniqueness", "cross_dataset", ["email"],
     {"cross_dataset_name": "uniqueness_ref", "cross_dataset_column": "email"}, (10, 6, 4)),
    ("uniqueness", "fuzzy", ["company_name"], {"fuzzy_threshold": 0.8}, (10, 8, 2)),
    ("uniqueness", "temporal", ["sensor_id"],
     {"temporal_column": "reading_time", "temporal_window": "24h"}, (10, 5, 5)),
    ("conformity", "standard", ["email"], {"standard_name": "email"}, (10, 8, 2)),
    ("conformity", "standard", ["phone"], {"standard_name": "phone"}, (10, 9, 1)),
    ("conformity", "regex", ["invoice_code"], {"regex_pattern": "^INV-[0-9]{6}$"}, (10, 8, 2)),
    ("conformity", "length", ["username"], {"min_length": 3, "max_length": 20}, (10, 9, 1)),
    ("conformity", "charset", ["first_name"], {"allowed_characters": "alpha"}, (10, 8, 2)),
    ("conformity", "case", ["country_code"], {"case_rule": "upper"}, (10, 9, 1)),
    ("conformity", "template", ["part_number"], {"template": "AA-9999"}, (10, 9, 1)),
    ("consistency", "intra_record", [],
     {"rule_expression": "status <> 'shipped' OR tracking_number IS NOT NULL"}, (10, 9, 1)),
    ("consistency", "formula", ["total"],
     {"expected_column": "total", "rule_expression": "total = quantity * unit_price"}, (10, 9, 1)),
    ("consistency", "temporal", ["end_date"], {"comparison_column": "start_date"}, (10, 9, 1)),
    ("consistency", "inter_record", [],
     {"group_by_columns": ["customer_id"], "comparison_columns": ["currency"]}, (10, 7, 3)),
    ("consistency", "cross_table", [],
     {"comparison_dataset": "consistency_ref", "join_keys": ["customer_id"],
      "comparison_columns": ["currency"]}, (10, 9, 1)),
    ("consistency", "aggregation", ["line_total"],
     {"group_by_columns": ["order_group"], "aggregation_function": "sum",
      "expected_column": "order_total"}, (5, 4, 1)),
    ("timeliness", "freshness", ["updated_at"], {"max_age": "24h"}, (10, 10, 0)),
    ("timeliness", "record_age", ["updated_at"], {"max_age": "30d"}, (10, 8, 2)),
    ("timeliness", "latency", ["event_time"],
     {"comparison_timestamp": "load_time", "max_age": "2h"}, (10, 7, 3)),
    ("timeliness", "processing_delay", ["proc_start"],
     {"comparison_timestamp": "proc_end", "max_age": "60m"}, (10, 7, 3)),
    ("timeliness", "delivery_window", ["delivery_time"],
     {"delivery_window_start": "06:00", "delivery_window_end": "09:00"}, (10, 6, 4)),
    ("timeliness", "heartbeat", ["updated_at"], {"expected_frequency": "1h"}, (1, 1, 0)),
    ("accuracy", "statistical", ["score"], {"statistical_threshold": 3.0}, (10, 10, 0)),
    ("accuracy", "statistical", ["score"],
     {"statistical_method": "iqr", "statistical_threshold": 1.5}, (10, 9, 1)),
    ("accuracy", "derived_value", ["bonus"], {"formula": "salary * bonus_rate"}, (10, 9, 1)),
    ("accuracy", "reference_comparison", ["name"],
     {"reference_dataset": "accuracy_ref", "join_keys": ["employee_id"]}, (10, 6, 2)),
    ("accuracy", "tolerated_deviation", ["salary"],
     {"reference_dataset": "accuracy_ref", "join_keys": ["employee_id"],
      "tolerance_type": "absolute", "tolerance_value": 1000}, (10, 7, 1)),
    ("reconciliation", "record_count", [], _RECON_P, (10, 10, 0)),
    ("reconciliation", "one_to_one", [], {**_RECON_P, "join_keys": ["txn_id"]}, (10, 9, 2)),
    ("reconciliation", "missing_extra", [], {**_RECON_P, "join_keys": ["txn_id"]}, (11, 9, 2)),
    ("reconciliation", "field_level", [],
     {**_RECON_P, "join_keys": ["txn_id"], "compare_columns": ["customer", "amount"]}, (9, 6, 3)),
    ("reconciliation", "aggregate", [], {**_RECON_P, "aggregate_column": "amount"}, (1, 0, 1)),
    ("reconciliation", "tolerance", ["amount"],
     {**_RECON_P, "join_keys": ["txn_id"], "tolerance_type": "absolute", "tolerance_value": 6},
     (9, 8, 1)),
]
