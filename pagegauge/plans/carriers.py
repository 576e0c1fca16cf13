"""Queries on what values carry at any depth."""

from __future__ import annotations

from ..operators import carriers as K
from .fixtures import duck_with, spark_rows as rows

QUERIES = {
    "carrier_findings": lambda s, d: K.carrier_findings(rows(s, d, "attributes"), "page_id", "name"),
    "retained_data": lambda s, d: K.retained_data(rows(s, d, "stored_records"), "seq"),
}

ORACLES = {
    # What each kind of attribute carries is known from how it is made.
    "carrier_findings": duck_with("attributes")
    + """, known(kind, depth, reason) AS (VALUES (0, 6, 'key'), (1, 0, 'key'), (2, 0, 'userinfo'), (3, 0, 'credential'), (4, 0, 'key'), (5, 9, 'too_deep'), (7, 0, 'too_long'),
      (8, 0, 'encoding'), (9, 0, 'key'), (11, 2, 'key'), (12, 0, 'bad_address'))
    SELECT page_id, name, CAST(depth AS INTEGER) AS depth, reason FROM attributes JOIN known ON kind = page_id % 14""",
    "retained_data": duck_with("stored_records")
    + f""", j AS (SELECT seq, json, json_valid(json) AS ok FROM stored_records WHERE json IS NOT NULL),
    plain AS (SELECT seq, CASE WHEN ok THEN json END AS json FROM j),
    keys AS (SELECT seq, 'key' AS reason, count(*) AS n FROM plain, json_tree(plain.json) AS t
      WHERE regexp_matches(t.key, '{K.VALUE_KEYS}') AND t.key NOT IN ('bodyBytes', 'emailConfirmation') GROUP BY seq)
    SELECT seq, 'broken' AS reason, CAST(1 AS BIGINT) AS n FROM j WHERE NOT ok UNION ALL SELECT * FROM keys
    UNION ALL SELECT * FROM (SELECT seq, 'value', CAST(len(regexp_extract_all(json, '{K.SYNTHETIC}')) AS BIGINT) AS n FROM j) WHERE n > 0""",
}
