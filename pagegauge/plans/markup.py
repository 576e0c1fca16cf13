"""Queries on elements, names, options and sanitised pages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import markup as M
from .fixtures import duck_with, spark_rows as rows


def names(s, d):
    """Names of controls by their place on the page."""
    found = M.control_names(M.page_elements(rows(s, d, "named_pages")))
    place = F.row_number().over(W.partitionBy("page_id").orderBy("node")) - 1
    return found.select("page_id", place.cast("long").alias("place"), "type", "accessible_name", "question")


def approvals(s, d):
    """Approvals that sanitising gives, by category and changed field."""
    found = M.sanitize_html(rows(s, d, "named_pages")).select("page_id", F.inline("approvals"))
    return found.select("page_id", "category", F.explode("fields").alias("field")).groupBy("category", "field").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


QUERIES = {
    "control_names": names,
    "control_options": lambda s, d: M.control_options(M.page_elements(rows(s, d, "named_pages"), frozenset({"option"}))).drop("control"),
    "sanitize_html": lambda s, d: M.sanitize_html(rows(s, d, "rich_pages")).select("page_id", "counters.*", "html"),
    "sanitize_approvals": approvals,
}

ORACLES = {
    "control_names": duck_with("named_pages")
    + """SELECT page_id, unnest(range(5)) AS place, unnest(['text', 'email', 'radio', 'submit', 'select']) AS type,
      unnest(['Word ' || page_id || ' Verb ' || page_id % 7, 'For ' || page_id, 'Around ' || page_id, 'Go ' || page_id, 'pick ' || page_id]) AS accessible_name,
      unnest(['', '', 'Legend ' || page_id % 5, '', '']) AS question
    FROM named_pages""",
    "control_options": duck_with("named_pages")
    + """SELECT page_id, CAST(unnest(range(4)) AS INTEGER) AS place, unnest(['-', 'n', 'Big ' || page_id, 'Other']) AS text,
      CAST(unnest([0, 1, length('big ' || page_id), length('k' || page_id)]) AS INTEGER) AS value_length,
      unnest(['empty', CASE WHEN page_id % 3 < 2 THEN 'common-enum' ELSE 'opaque' END, 'same-as-visible-text', 'opaque']) AS option_class,
      unnest([false, false, false, true]) AS disabled
    FROM named_pages""",
    "sanitize_approvals": duck_with("named_pages")
    + """, f AS (
      SELECT page_id, 'forms' AS category, unnest(['actionAttribute', 'action', 'methodAttribute', 'method']) AS field FROM named_pages
      UNION ALL SELECT page_id, 'controls', unnest(['optionsHash', 'options']) FROM named_pages
    ) SELECT category, field, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM f GROUP BY ALL""",
}
