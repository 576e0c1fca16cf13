"""URL classification, private destinations, credential audits and asset inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.expressions import bound, decoded, host, ipv4, ipv6, origin

#: Reserved IPv4 ranges (RFC 6890 and others) as base and prefix length.
RESERVED = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]
#: Host suffixes and names that are no public hosts.
SUFFIXES = ("localhost", "local", "internal", "corp", "lan", "home", "home[.]arpa", "onion")
#: Reserved IPv6 ranges as base words, a name, and prefix length.
RESERVED6 = [
    ((0xFC00,), "fc00::/7", 7), ((0xFE80,), "fe80::/10", 10), ((0xFEC0,), "fec0::/10", 10), ((0xFF00,), "ff00::/8", 8),
    ((0x64, 0xFF9B), "64:ff9b::/32", 32), ((0x100, 0, 0, 0), "100::/64", 64), ((0x2001, 0), "2001::/23", 23), ((0x2001, 0xDB8), "2001:db8::/32", 32), ((0x2002,), "2002::/16", 16),
]


def reserved6(words: Column) -> Column:
    """Name of the reserved range of an IPv6 address; null if it is public."""
    word = lambda i: F.get(words, F.lit(i))
    out = F.when(F.forall(F.slice(words, 1, 7), lambda w: w == 0) & (word(7) <= 1), F.when(word(7) == 0, "::").otherwise("::1"))
    for base, name, bits in RESERVED6:
        inside = F.lit(True)
        for i, want in enumerate(base):
            # the bits of this word that belong to the prefix
            own = min(16, max(0, bits - 16 * i))
            step = 1 << (16 - own)
            inside &= F.floor(word(i) / step) == want // step
        out = out.when(inside, name)
    return out


def reserved_ranges() -> list[tuple[str, int, int]]:
    """(range, first, last) as numbers."""
    out = []
    for base, bits in RESERVED:
        a, b, c, d = map(int, base.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        out.append((f"{base}/{bits}", low, low + (1 << (32 - bits)) - 1))
    return out


def classify_targets(urls: DataFrame) -> DataFrame:
    """(page_id, url, target): unsafe (malformed, credentials, other schemes), same origin as ``allowed``, or external."""
    unsafe = origin("url").isNull() | F.col("url").rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@") | ~F.lower("url").rlike("^https?://")
    return urls.select("page_id", "url", F.when(unsafe, "unsafe").when(origin("url") == origin("allowed"), "same_origin").otherwise("external").alias("target"))


def private_destinations(urls: DataFrame) -> DataFrame:
    """(page_id, host, reason) of URLs to private or reserved hosts. Addresses that an IPv6 address maps or embeds are
    judged as IPv4. The ranges are fixed lists, so they are literals of the plan."""

    def embedded(w: Column) -> Column:
        word = lambda i: F.get(w, F.lit(i))
        mapped = F.forall(F.slice(w, 1, 5), lambda x: x == 0) & word(5).isin(0, 0xFFFF) & ~((word(5) == 0) & (word(6) == 0) & (word(7) <= 1))
        return F.when(mapped, word(6) * 65536 + word(7))

    def judged(x: Column) -> Column:
        h, ip, words = x["host"], x["ip"], x["words"]
        reason: Column = F.when(F.lit(False), "")
        for name, low, high in reserved_ranges():
            reason = reason.when(ip.between(low, high), name)
        named = h.rlike("(^|[.])(" + "|".join(SUFFIXES) + ")$")
        reason = reason.when(words.isNotNull() & ip.isNull(), reserved6(words)).when(named, "suffix")
        return reason.when(ip.isNull() & words.isNull() & ~h.contains("."), "dotless")

    def parsed(h: Column) -> Column:
        return bound(ipv6(h), lambda w: F.struct(h.alias("host"), F.coalesce(ipv4(h), embedded(w)).alias("ip"), w.alias("words")))

    h = F.regexp_replace(host("url"), "[.]$", "")
    row = urls.select("page_id", bound(bound(h, parsed), lambda x: F.struct(x["host"].alias("host"), judged(x).alias("reason"))).alias("x"))
    return row.select("page_id", "x.host", "x.reason").where("reason is not null")


#: Names of parameters and keys that carry credentials or personal data; a gap is anything between words.
_GAP = "[^a-z0-9]*"
SENSITIVE_NAMES = (
    f"access{_GAP}token", "address", f"api{_GAP}key", "auth", "authorization", "code", "credential", "credentials", "csrf", f"csrf{_GAP}token", f"e{_GAP}mail", f"first{_GAP}name", f"full{_GAP}name",
    f"last{_GAP}name", "jwt", "password", "phone", f"phone{_GAP}number", f"saml{_GAP}response", "secret", "session", f"session{_GAP}id", "sig", "signature", "token",
)
_NAMES = "(?i)(?:^|[^a-z0-9])(?:" + "|".join(SENSITIVE_NAMES) + ")"
SENSITIVE = _NAMES + "(?:$|[^a-z0-9])"
CARRIER = _NAMES + f"(?:$|{_GAP}[:=])"
#: Patterns of personal data and of credentials in paths.
EMAIL = r"(?i)\b[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+\b"
PHONE = r"(?i)(?:^|[^a-z0-9])(?:\+[0-9]{10,15}|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4})(?:$|[^a-z0-9])"
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
JWT = r"(?i)^[a-z0-9_-]{8,}\.[a-z0-9_-]{8,}\.[a-z0-9_-]{6,}$"
API_KEY = "(?i)^(?:sk-[a-z0-9_-]{16,}|(?:sk|pk)_(?:live|test)_[a-z0-9_-]{12,}|gh[pousr]_[a-z0-9]{16,}|github_pat_[a-z0-9_]{20,}|xox[baprs]-[a-z0-9-]{16,}|aiza[a-z0-9_-]{20,}|akia[a-z0-9]{12,})$"
MARKER = "(?i)^(?:activate(?:-account)?|email-verification|invite(?:-token)?|invitation|magic(?:-link)?|password-reset|reset(?:-password|-token)?|verify(?:-email)?)$"
INLINE = "(?i)^(?:activate(?:-account)?|email-verification|invite|invitation|magic(?:-link)?|password-reset|reset(?:-password)?|verify(?:-email)?)[-_=.:]+(?:token[-_=.:]*)?(.{8,})$"
#: Addresses inside a value, and what may stand before them.
EMBEDDED = r"""(?i)(?:^|[\s("'=])((?:https?:)?//[^\s"'<>}\]]+)"""
ENCODED = "%[0-9a-fA-F]{2}"
#: Longest value and most embedded addresses that are looked into.
LONGEST, MOST = 16384, 50


def _words(c: Column) -> Column:
    """camelCase split into words."""
    return F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")


def _personal(issue: Column, c: Column) -> Column:
    return issue.when(c.rlike(EMAIL), "email").when(c.rlike(PHONE), "phone")


def _segment_issue(v: Column, after: Column) -> Column:
    """Issue of a decoded path segment that another one follows."""
    inline = F.regexp_extract(v, INLINE, 1)
    out = _personal(F.when(v.rlike(ENCODED) | (F.length(v) > LONGEST), "path_encoded"), v).when(v.rlike(JWT), "path_jwt").when(v.rlike(API_KEY), "path_api_key")
    out = out.when((inline != "") & ~inline.rlike(UUID), "path_named")
    return out.when(v.rlike(MARKER) & (F.length(after) >= 8) & ~after.rlike(UUID), "path_marker")


def _inner(v: Column) -> Column:
    """Addresses in a decoded value, with a scheme."""
    found = F.transform(F.regexp_extract_all(v, F.lit(EMBEDDED), F.lit(1)), lambda x: F.regexp_replace(x, "[),.;]+$", ""))
    found = F.filter(found, lambda x: x.rlike("(?i)^(?:https?:)?//[^/?#]"))
    return F.transform(found, lambda x: F.when(x.startswith("//"), F.concat(F.lit("https:"), x)).otherwise(x))


def credential_url_audit(urls: DataFrame, nested: int = 4) -> DataFrame:
    """(page_id, level, issue): first issue of every URL, and of the addresses that its parameters' values hold, up to
    ``nested`` levels deep, by as many steps over an ever smaller table.

    The order is user information, the path's segments from the left, the parameters from the left (name; encoding and
    length; keys with values, as in JSON or ``key=value``; personal data; addresses too many or too deep), fragment.
    Texts are percent-decoded up to four times; what is still encoded is an issue. JSON is looked through as text.
    A null URL has no issue.
    """

    def parameter(p: Column) -> Column:
        halves = F.split(F.translate(p, "+", " "), "=", 2)
        name, raw = F.get(halves, F.lit(0)), F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
        return F.struct(decoded(name).alias("name"), decoded(raw).alias("v"), (F.length(raw) > LONGEST).alias("long"))

    def judged(depth: int):
        def of(x: Column) -> Column:
            issue = F.when(x["name"].rlike(ENCODED) | _words(x["name"]).rlike(SENSITIVE), "parameter").when(x["v"].rlike(ENCODED), "value_encoded").when(x["long"], "value_long")
            issue = _personal(issue.when(_words(x["v"]).rlike(CARRIER), "carrier"), x["v"]).when(F.size(x["inner"]) > MOST, "too_many")
            return issue.when(F.size(x["inner"]) > 0, "too_deep") if depth == nested else issue

        return of

    def first(issues: Column) -> Column:
        return F.get(F.filter(issues, lambda i: i.isNotNull()), F.lit(0))

    out = None
    level = urls.select("page_id", "url")
    for depth in range(nested + 1):
        segments = F.transform(F.split(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda s: decoded(s))
        params = F.filter(F.split(F.regexp_extract("url", "^[^?#]*[?]([^#]*)", 1), "&"), lambda p: p != "")
        params = F.transform(F.transform(params, parameter), lambda x: F.struct(x["name"].alias("name"), x["v"].alias("v"), x["long"].alias("long"), _inner(x["v"]).alias("inner")))
        at = level.select("page_id", "url", params.alias("params"), decoded(F.regexp_extract("url", "#(.*)$", 1)).alias("fragment"), segments.alias("segments"))
        path = first(F.transform("segments", lambda v, i: _segment_issue(v, F.coalesce(F.get("segments", i + 1), F.lit("")))))
        frag = F.col("fragment")
        frag_bad = frag.rlike(ENCODED) | (F.length(frag) > LONGEST) | ((frag != "") & (_words(frag).rlike(CARRIER) | frag.rlike(EMAIL) | frag.rlike(PHONE)))
        issue = F.when(F.col("url").rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@"), "userinfo").otherwise(F.coalesce(path, first(F.transform("params", judged(depth))), F.when(frag_bad, "fragment")))
        here = at.select("page_id", F.lit(depth).alias("level"), issue.alias("issue")).where("issue is not null")
        out = here if out is None else out.unionByName(here)
        if depth < nested:
            level = at.select("page_id", F.explode(F.flatten(F.transform("params", lambda x: x["inner"]))).alias("url"))
    return out


def reconcile_inventories(responses: DataFrame, graph: DataFrame, dom: DataFrame) -> DataFrame:
    """(page_id, path, reason): stylesheets that one of three inventories has and another lacks."""
    out = None
    sides = {"response": responses, "graph": graph, "dom": dom}
    for have, a in sides.items():
        for lack, b in sides.items():
            if have != lack:
                part = a.select("page_id", "path").distinct().join(b.select("page_id", "path"), ["page_id", "path"], "left_anti").withColumn("reason", F.lit(f"{have}_not_{lack}"))
                out = part if out is None else out.unionByName(part)
    return out


def external_assets(*sources: DataFrame) -> DataFrame:
    """(page_id, url, target): union of independently observed URLs, each once, classified."""
    rows = None
    for d in sources:
        d = d.select("page_id", "url", "allowed")
        rows = d if rows is None else rows.unionByName(d)
    return classify_targets(rows.distinct())


def localize_refs(refs: DataFrame, resources: DataFrame) -> DataFrame:
    """(page_id, target, local): stored name of a reference's resource, by its URL, else without fragment; other http(s)
    references become inert."""
    names = resources.select(F.col("url").alias("key"), F.concat(F.substring(F.sha2("url", 256), 1, 20), F.lit(".bin")).alias("name")).distinct()
    a, b = names.toDF("k1", "exact"), names.toDF("k2", "bare")
    out = refs.join(a, F.col("target") == F.col("k1"), "left").join(b, F.regexp_replace("target", "#.*$", "") == F.col("k2"), "left")
    return out.select("page_id", "target", F.coalesce("exact", "bare", F.when(F.col("target").rlike("^https?://"), "data:,").otherwise(F.col("target"))).alias("local"))


#: Directives whose presence and mode are summarised.
DIRECTIVES = ("script-src", "script-src-elem", "script-src-attr", "connect-src", "form-action", "object-src", "frame-ancestors")
#: What a strict policy limits to the page itself or nothing, to nothing, and to either if it is there.
SELF_OR_NONE, NONE, OPTIONAL = ("script-src", "connect-src", "form-action"), ("object-src", "frame-ancestors"), ("script-src-elem", "script-src-attr")


def security_headers(responses: DataFrame) -> DataFrame:
    """(page_id, n_policies, <directive>..., frame_options, strict): the first occurrence of a directive in each policy
    counts; a page is strict when one of its policies lets scripts, connections and forms reach nothing but the page's
    own origin, allows no objects and no framing, and gives none of these directives twice."""
    policies = responses.select("page_id", "frame_options", "has_refresh", F.posexplode_outer(F.filter(F.split(F.lower("csp"), ","), lambda p: F.trim(p) != "")).alias("policy", "text"))
    parts = policies.select("page_id", "policy", F.posexplode_outer(F.split("text", ";")).alias("i", "part")).select("page_id", "policy", "i", F.trim("part").alias("part"))
    parts = parts.select("page_id", "policy", "i", F.regexp_extract("part", "^([a-z-]+)", 1).alias("name"), F.trim(F.regexp_replace("part", "^[a-z-]+", "")).alias("value"))
    mode = F.when(F.col("value") == "'none'", "none").when(F.col("value") == "'self'", "self").otherwise("other")
    first = parts.where(F.col("name").isin(*DIRECTIVES)).groupBy("page_id", "policy", "name").agg(F.min_by(mode, "i").alias("mode"), F.count("*").alias("n"))
    once = lambda d: F.max(F.when((F.col("name") == d) & (F.col("n") == 1), F.col("mode")))
    strict = F.lit(True)
    for d in SELF_OR_NONE:
        strict &= F.coalesce(once(d).isin("self", "none"), F.lit(False))
    for d in NONE:
        strict &= F.coalesce(once(d) == "none", F.lit(False))
    for d in OPTIONAL:
        strict &= F.count_if((F.col("name") == d) & ~((F.col("n") == 1) & F.col("mode").isin("self", "none"))) == 0
    modes = [F.max(F.when(F.col("name") == d, F.col("mode"))).alias(d) for d in DIRECTIVES]
    wide = first.groupBy("page_id", "policy").agg(*modes, strict.alias("strict"))
    per = wide.groupBy("page_id").agg(F.count("*").alias("n_policies"), *[F.array_join(F.array_sort(F.collect_set(d)), ",").alias(d.replace("-", "_")) for d in DIRECTIVES], F.bool_or("strict").alias("strict"))
    doubled = first.groupBy("page_id").agg(F.bool_or(F.col("n") > 1).alias("duplicated"))
    frame = F.when(F.upper("frame_options").isin("DENY", "SAMEORIGIN"), F.lower("frame_options")).when(F.col("frame_options") == "", "missing").otherwise("other")
    out = responses.select("page_id", frame.alias("frame"), "has_refresh").join(per, "page_id", "left").join(doubled, "page_id", "left")
    return out.select("page_id", "frame", "has_refresh", F.coalesce("n_policies", F.lit(0)).alias("n_policies"), *[F.coalesce(d.replace("-", "_"), F.lit("")).alias(d.replace("-", "_")) for d in DIRECTIVES], F.coalesce("strict", F.lit(False)).alias("strict"), F.coalesce("duplicated", F.lit(False)).alias("duplicated"))


def validate_evidence(snapshots: DataFrame) -> DataFrame:
    """(page_id, violation): what makes stored evidence unusable."""
    flags = {
        "retained_over_limit": F.col("retained") > F.col("lim"),
        "retained_not_total": ~F.col("truncated") & (F.col("retained") != F.col("total")),
        "truncated_without_loss": F.col("truncated") & (F.col("retained") >= F.col("total")),
        "ratio_missing": F.col("ratio").isNull(),
        "ratio_out_of_range": ~F.col("ratio").between(0, 1),
        "viewport_mismatch": F.col("viewport") != F.col("expected"),
    }
    return snapshots.select("page_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))).alias("violation"))


def disclosure_persistence(samples: DataFrame, variants: int = 8, instants: int = 3) -> DataFrame:
    """(page_id, n_variants, missing, hidden, persistent): every variant of the media matrix has to be sampled at every
    instant, visible and unoccluded throughout, in its own environment."""
    per = samples.groupBy("page_id", "variant").agg(F.count("*").alias("n"), F.bool_and(F.col("visible") & ~F.col("occluded") & (F.col("environment") == F.col("variant"))).alias("shown"))
    out = per.groupBy("page_id").agg(F.count("*").alias("n_variants"), F.count_if(~F.col("shown")).alias("hidden"), F.bool_and(F.col("n") == instants).alias("complete"))
    return out.select("page_id", "n_variants", (F.lit(variants).cast("long") - F.col("n_variants")).alias("missing"), "hidden", ((F.col("n_variants") == variants) & F.col("complete") & (F.col("hidden") == 0)).alias("persistent"))


def unsafe_forms(controls: DataFrame, allowed: str = "https://shop.example.com", submit: str = "/submit") -> DataFrame:
    """(page_id, ordinal, reason) of controls whose form goes elsewhere, carries a query, or isn't a plain POST."""
    action = F.col("form_action")
    reasons = {
        "origin": ~origin(action).eqNullSafe(F.lit(allowed)),
        "path": F.regexp_extract(action, "^[a-z]+://[^/?#]*([^?#]*)", 1) != submit,
        "query_or_fragment": action.rlike("[?#]"),
        "method": F.col("form_method") != "post",
        "enctype": ~F.col("form_enctype").isin("multipart/form-data", "application/x-www-form-urlencoded"),
    }
    return controls.select("page_id", "ordinal", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()]))).alias("reason"))


def unsafe_hidden_values(controls: DataFrame, placeholder: int = 9) -> DataFrame:
    """Hidden controls with a value that isn't the synthetic placeholder, which is known by its length."""
    return controls.where((F.col("type") == "hidden") & (F.col("value_length") > 0) & (F.col("value_length") != placeholder)).select("page_id", "ordinal", "name", "value_length")


def integrity_audit(**findings: DataFrame) -> DataFrame:
    """(page_id, code, evidence_count, n_codes): all rule outputs (each with page_id) as long rows, with the number of
    codes of the page; a page without rows passes."""
    rows = None
    for code, d in findings.items():
        part = d.groupBy("page_id").agg(F.count("*").alias("evidence_count")).withColumn("code", F.lit(code))
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("n_codes", F.count("*").over(W.partitionBy("page_id")))
