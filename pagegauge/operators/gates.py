"""Score gates, stages and the regression ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

#: Default limit of each gate; 1 and 0 switch the two requirements on and off.
GATES = {
    "tolerant": 0.15,
    "strict": 2.0,
    "unapproved": 0.0,
    "require_dimensions": 1.0,
    "require_stable": 1.0,
    "masked_pixels": 0.0,
    "critical_failures": 0.0,
    "page_errors": 0.0,
    "console_errors": 0.0,
    "blocked_writes": 0.0,
    "blocked_private_reads": 0.0,
}
#: The codes of a gate report in its order.
CODES = (
    "BASELINE_CAPTURE_API_TAMPERING",
    "CANDIDATE_CAPTURE_API_TAMPERING",
    "DIMENSIONS",
    "PIXEL_TOLERANT",
    "PIXEL_STRICT",
    "CANDIDATE_UNSTABLE",
    "MASKED_PIXELS",
    "CANDIDATE_CRITICAL_RESOURCE",
    "CANDIDATE_PAGE_ERROR",
    "CANDIDATE_CONSOLE_ERROR",
    "CANDIDATE_BLOCKED_WRITE_ATTEMPT",
    "CANDIDATE_BLOCKED_PRIVATE_READ_ATTEMPT",
    "SEMANTIC_UNAPPROVED",
    "SEMANTIC_DETAILS_TRUNCATED",
)
#: Stage ladder by the largest tolerant difference of a run, in percent.
STAGES = [("pixel_perfect", 0.0), ("near_exact", 0.15), ("typography", 0.5), ("geometry", 2.0), ("runnable", 5.0)]
#: Parts of an evaluation, and the code that a failed part adds to the run record.
PARTS = {"source_self": "SOURCE_UNSTABLE", "candidate_self": "CAPTURE", "source_candidate": None, "integrity": "SAFETY", "interaction": "INTERACTION"}
#: Words in an interaction's failure codes that blame the backend.
BACKEND_WORDS = "(?i)SUBMISSION|RECEIPT|EMAIL|BACKEND|LOCAL"


def resolve_gates(viewports: DataFrame, policy: DataFrame, override: DataFrame | None = None, defaults: dict[str, float] | None = None) -> DataFrame:
    """(viewport, gate, lim): the override's limit, else the viewport's own, else the policy's, else the default.

    ``policy(viewport, gate, lim)`` holds policy-wide limits under a null viewport; ``override(gate, lim)`` holds those
    of a single evaluation. Limits of unknown gates are ignored.
    """
    limits = F.array(*[F.struct(F.lit(g).alias("gate"), F.lit(float(x)).alias("lim")) for g, x in (defaults or GATES).items()])
    out = viewports.select("viewport").distinct().select("viewport", F.inline(limits))
    base = policy.where("viewport is null").select("gate", F.col("lim").alias("base"))
    own = policy.where("viewport is not null").select("viewport", "gate", F.col("lim").alias("own"))
    out = out.join(base.hint("merge"), "gate", "left").join(own.hint("merge"), ["viewport", "gate"], "left")
    chain = ["own", "base", "lim"]
    if override is not None:
        out = out.join(override.select("gate", F.col("lim").alias("forced")).hint("merge"), "gate", "left")
        chain = ["forced", *chain]
    return out.select("viewport", "gate", F.coalesce(*chain).alias("lim"))


def evaluate_gates(metrics: DataFrame, gates: DataFrame, keep: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(<keep>, viewport, passed, failures) of each row of ``metrics``; failures are codes in the report's order.

    Without a percentage, dimensions, stability or tampering evidence (null) the gate fails; other counts that are
    null are 0. Details are truncated when fewer mismatches are retained than were reported. A viewport without limits
    has no row.
    """
    limits = gates.groupBy("viewport").pivot("gate", list(GATES)).agg(F.first("lim"))
    limits = limits.select("viewport", *[F.col(g).alias(f"lim_{g}") for g in GATES])

    def holds(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    def within(name: str) -> Column:
        return F.coalesce(F.col(name) <= F.col(f"lim_{name}"), F.lit(False))

    def few(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) <= F.col(f"lim_{name}")

    checks = [
        F.coalesce(F.col("baseline_tampering") == 0, F.lit(False)),
        F.coalesce(F.col("candidate_tampering") == 0, F.lit(False)),
        (F.col("lim_require_dimensions") == 0) | holds("dimensions_match"),
        within("tolerant"),
        within("strict"),
        (F.col("lim_require_stable") == 0) | holds("stable"),
        few("masked_pixels"),
        few("critical_failures"),
        few("page_errors"),
        few("console_errors"),
        few("blocked_writes"),
        few("blocked_private_reads"),
        few("unapproved"),
        F.coalesce("retained", F.lit(0)) == F.coalesce("reported", F.lit(0)),
    ]
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(code)) for c, code in zip(checks, CODES, strict=True)]))
    out = metrics.join(limits.hint("merge"), "viewport").withColumn("failures", failed)
    return out.select(*keep, "viewport", (F.size("failures") == 0).alias("passed"), "failures")


def _run_code(failure: Column) -> Column:
    """Code of a run record for the failure code of a gate."""
    code = F.when(failure == "DIMENSIONS", "GEOMETRY").when(failure.startswith("PIXEL_"), "CONTENT").when(failure.startswith("SEMANTIC_"), "SEMANTICS")
    return code.when(failure == "CANDIDATE_CRITICAL_RESOURCE", "ASSETS").when(failure == "CANDIDATE_UNSTABLE", "CAPTURE").otherwise("TOOLING")


def run_failure_codes(parts: DataFrame, key: str) -> DataFrame:
    """(key, codes, passed): sorted distinct codes of a run from ``parts(key, part, passed, failures)``.

    Parts are those of ``PARTS`` and ``command``, whose failure means broken tooling. A part that a run doesn't have
    counts as failed, a run without commands has no failed ones. Failures of several rows of a part add up.
    """
    bad = ~F.coalesce(F.col("passed"), F.lit(False))
    rows = parts.select(key, "part", bad.alias("bad"), F.coalesce("failures", F.array().cast("array<string>")).alias("f"))
    gate = F.when(F.col("part") == "source_candidate", F.transform("f", _run_code))
    backend = F.when((F.col("part") == "interaction") & F.col("bad") & F.exists("f", lambda c: c.rlike(BACKEND_WORDS)), F.array(F.lit("BACKEND")))
    tool = F.when((F.col("part") == "command") & F.col("bad"), F.array(F.lit("TOOLING")))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("own", F.array_distinct(F.concat(*[F.coalesce(c, none) for c in (gate, backend, tool)])))
    per_part = rows.groupBy(key, "part").agg(F.bool_or("bad").alias("bad"), F.array_distinct(F.flatten(F.collect_set("own"))).alias("own"))
    run = per_part.groupBy(key).agg(
        F.flatten(F.collect_list("own")).alias("own"),
        F.bool_or(F.when(F.col("part").isin(*PARTS, "command"), F.col("bad"))).alias("bad"),
        F.collect_set(F.when(~F.col("bad"), F.col("part"))).alias("good"),
    )
    missing = [F.when(~F.array_contains("good", p), F.lit(code)) for p, code in PARTS.items() if code]
    complete = F.size(F.array_intersect("good", F.array(*map(F.lit, PARTS)))) == len(PARTS)
    codes = F.array_sort(F.array_distinct(F.concat("own", F.array_compact(F.array(*missing)))))
    return run.select(key, codes.alias("codes"), (complete & ~F.coalesce("bad", F.lit(False))).alias("passed"))


def case_result(parts: DataFrame, key: str) -> DataFrame:
    """(key, <part>..., accepted): all parts of an evaluation and all its commands have to pass; a part that is
    missing fails."""
    wide = parts.groupBy(key).pivot("part", [*PARTS, "command"]).agg(F.bool_and(F.coalesce("passed", F.lit(False))))
    all_ = F.coalesce("command", F.lit(True))
    for p in PARTS:
        all_ = all_ & F.coalesce(F.col(p), F.lit(False))
    return wide.select(key, *[F.coalesce(p, F.lit(False)).alias(p) for p in PARTS], all_.alias("accepted"))


def promotion_stage(scores: DataFrame, key: str) -> DataFrame:
    """(key, worst, stage): highest stage that the worst viewport reaches."""
    ladder: Column = F.when(F.lit(False), "")
    for name, most in STAGES:
        ladder = ladder.when(F.col("worst") <= most, name)
    return scores.groupBy(key).agg(F.max("tolerant").alias("worst")).withColumn("stage", ladder.otherwise("none"))


def iteration_ledger(iterations: DataFrame, parts: tuple[str, ...] = ("v1", "v2", "v3", "v4", "v5")) -> DataFrame:
    """(series, seq, best_seq, is_best, regressed): lexicographic best so far; the earlier one wins ties.

    Components are rounded to 12 places, which is the tolerance of a comparison.
    """
    vector = F.struct(*[F.round(p, 12).alias(p) for p in parts])
    run = W.partitionBy("series").orderBy("seq")
    before = F.min(F.struct(vector.alias("v"), F.col("seq").alias("s"))).over(run.rowsBetween(W.unboundedPreceding, -1))
    rows = iterations.withColumn("v", vector).withColumn("before", before)
    best = F.col("before").isNull() | (F.col("v") < F.col("before.v"))
    return rows.select("series", "seq", F.when(best, F.col("seq")).otherwise(F.col("before.s")).alias("best_seq"), best.alias("is_best"), (F.col("before").isNotNull() & (F.col("v") > F.col("before.v"))).alias("regressed"))


def ledger_admit(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose id isn't stored yet; of repeated ids the first sequence number."""
    first = new.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy("seq"))).where("rn = 1").drop("rn")
    return first.join(stored.select(key).distinct(), key, "left_anti")


def bind_cases(cases: DataFrame, registry: DataFrame) -> DataFrame:
    """(run_id, series, viewport): cases whose id has exactly one registry row with the same viewport."""
    single = registry.withColumn("copies", F.count("*").over(W.partitionBy("series"))).where("copies = 1").drop("copies")
    return cases.join(single.withColumnRenamed("viewport", "own"), "series").where("viewport = own").select("run_id", "series", "viewport")
