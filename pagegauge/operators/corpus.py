"""Corpus jobs: redaction, personal data, credentials, sanitising, contamination, tree digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Personal data in prose; the patterns match it alone, without what stands around it, as it is replaced.
EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
PHONE = "[+][0-9][0-9 ()-]{7,}[0-9]"

#: Redaction steps in order: name, pattern, replacement. Each works on what the steps before have left.
REDACTIONS = [
    ("authorization", "(?i)authorization: *[a-z]+ +[A-Za-z0-9+/=._-]+", "authorization: [redacted]"),
    ("cookie", "(?i)(set-)?cookie: *[^\n]+", "cookie: [redacted]"),
    ("bearer", "(?i)bearer +[A-Za-z0-9+/=._-]{8,}", "bearer [redacted]"),
    ("key_value", "(?i)(password|passwd|secret|api_key|apikey|token)([\"']? *[:=] *)([\"'][^\"'\n]*[\"']|[^ \n\"',;&]+)", "$1$2[redacted]"),
    ("url", "https?://[^ \n\"'<>]+", "[url]"),
    ("email", EMAIL, "[email]"),
    ("phone", PHONE, "[phone]"),
]


def redacted(text: Column) -> tuple[Column, dict[str, Column]]:
    """Redacted text, and the number of hits of each step."""
    hits = {}
    for name, pattern, to in REDACTIONS:
        hits[name] = F.regexp_count(text, F.lit(pattern)).cast("long")
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    return text, hits


def redact_corpus(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, n_<step>..., redacted)."""
    text, hits = redacted(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", *[h.alias(f"n_{k}") for k, h in hits.items()], text.alias("redacted"))


def redact_strings(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every string of every column redacted, however nested; column names in ``keep`` (codes, keys) stay."""

    def walk(c: Column, kind: T.DataType, name: str) -> Column:
        if name in keep:
            return c
        if isinstance(kind, T.StringType):
            return redacted(c)[0]
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType, name))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda k, v: walk(v, kind.valueType, name))
        return c

    return df.select(*[walk(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def write_redacted(df: DataFrame, path: str, keep: tuple[str, ...] = ()) -> None:
    """Sink through which no unredacted string passes."""
    redact_strings(df, keep).write.mode("errorifexists").parquet(path)


FORMATTED_PHONE = "[(][0-9]{3}[)] ?[0-9]{3}-[0-9]{4}"


def pii_findings(docs: DataFrame) -> DataFrame:
    """(source, lang, kind, n, n_docs) of e-mail addresses, international and formatted phone numbers."""
    kinds = {"email": EMAIL, "international_phone": PHONE, "formatted_phone": FORMATTED_PHONE}
    counted = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count("text", F.lit(p)).cast("long").alias("n")) for k, p in kinds.items()])
    rows = docs.select("source", "lang", F.inline(counted)).where("n > 0")
    return rows.groupBy("source", "lang", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


CARRIER = "(?i)([a-z_]*(?:token|secret|password|api_key|apikey))[\"']? *[:=] *[\"']?([A-Za-z0-9+/=._-]{8,})"


def credential_carriers(docs: DataFrame) -> DataFrame:
    """(doc_id, key, value_length, n): sensitive keys with a value in JSON, key=value or query form; never the value."""
    zipped = F.arrays_zip(F.regexp_extract_all("text", F.lit(CARRIER), F.lit(1)).alias("key"), F.regexp_extract_all("text", F.lit(CARRIER), F.lit(2)).alias("value"))
    rows = docs.select("doc_id", F.explode(zipped).alias("c"))
    return rows.groupBy("doc_id", F.lower("c.key").alias("key"), F.length("c.value").alias("value_length")).agg(F.count("*").alias("n"))


#: The notice that a copy needs, the negation that it needs, and claims that it may not make.
NOTICE, NEGATION = r"\bsimulation\b", r"\bnot\s+the\s+original(?:\s+(?:website|site))?\b"
CLAIM = r"\b(?:official|authentic|genuine|original|real\s+(?:website|site))\b"


def disclosure_copy(docs: DataFrame) -> DataFrame:
    """(doc_id, has_notice, negated, claims, accepted): notice and negation are needed, claims besides it forbidden."""
    text = F.lower("text")
    bare = F.regexp_replace(text, NEGATION, " ")
    out = docs.select("doc_id", text.rlike(NOTICE).alias("has_notice"), text.rlike(NEGATION).alias("negated"), bare.rlike(CLAIM).alias("claims"))
    return out.withColumn("accepted", F.col("has_notice") & F.col("negated") & ~F.col("claims"))


#: Flat sanitising steps: counter, pattern, replacement.
SANITISE = [
    ("comments", "<!--[^>]*-->", ""),
    ("scripts", "<script[^>]*>[^<]*(?:<[^/][^<]*|</[^s][^<]*)*</script>", ""),
    ("scripts_external", "<script[^>]*></script>", ""),
    ("styles_external", "<link rel=\"stylesheet\"[^>]*>", ""),
    ("event_handlers", " on[a-z]+=\"[^\"]*\"", ""),
    ("nonces", " (?:nonce|integrity|ping|srcdoc)=\"[^\"]*\"", ""),
    ("links", " href=\"[^\"#][^\"]*\"", " href=\"#\""),
    ("form_actions", " action=\"[^\"]*\"", " action=\"/submit\""),
    ("values", " value=\"[^\"]+\"", " value=\"synthetic\""),
]


def sanitize_pages(pages: DataFrame) -> DataFrame:
    """(page_id, n_<step>..., html): active and outgoing parts dropped or made inert, with a counter of each step."""
    html, counts = F.coalesce(F.col("html"), F.lit("")), []
    for name, pattern, to in SANITISE:
        counts.append(F.regexp_count(html, F.lit(pattern)).cast("long").alias(f"n_{name}"))
        html = F.regexp_replace(html, F.lit(pattern), F.lit(to))
    return pages.select("page_id", *counts, html.alias("html"))


def sanitize_counts(sanitized: DataFrame) -> DataFrame:
    """(step, n_pages, n): totals of the counters."""
    names = [c for c in sanitized.columns if c.startswith("n_")]
    long = sanitized.select(F.inline(F.array(*[F.struct(F.lit(n[2:]).alias("step"), F.col(n).alias("n")) for n in names])))
    return long.groupBy("step").agg(F.count_if(F.col("n") > 0).alias("n_pages"), F.sum("n").alias("n"))


def tree_digest(files: DataFrame) -> DataFrame:
    """(tree, n_files, n_bytes, digest): hash over sorted (path, mode, hash of content) lines. Contents are hashed
    first, so only short lines of a tree meet."""
    line = F.concat_ws("\u0000", "path", "mode", F.sha2("content", 256))
    return files.groupBy("tree").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("content")).cast("long").alias("n_bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\u0000"), 256).alias("digest"))


def evidence_inventory(files: DataFrame, most_files: int, most_file: int, most_total: int, most_text: int) -> DataFrame:
    """(tree, n_files, n_bytes, n_text, n_omitted, violations) against bounds."""
    size = F.octet_length("content")
    per = files.groupBy("tree").agg(F.count("*").alias("n_files"), F.sum(size).cast("long").alias("n_bytes"), F.count_if(size <= most_text).alias("n_text"), F.count_if(size > most_text).alias("n_omitted"), F.max(size).alias("largest"))
    broken = F.array_compact(F.array(F.when(F.col("n_files") > most_files, "too_many_files"), F.when(F.col("largest") > most_file, "file_too_large"), F.when(F.col("n_bytes") > most_total, "total_too_large")))
    return per.select("tree", "n_files", "n_bytes", "n_text", "n_omitted", F.array_join(broken, ",").alias("violations"))


def verify_manifest(tracked: DataFrame, actual: DataFrame) -> DataFrame:
    """(tree, path, problem): missing, unexpected, content or mode differs; directories are implied by paths."""
    side = lambda d, p: d.select("tree", "path", F.sha2("content", 256).alias(f"{p}_hash"), F.col("mode").alias(f"{p}_mode"))
    both = side(tracked, "t").join(side(actual, "a"), ["tree", "path"], "full_outer")
    problem = F.when(F.col("a_hash").isNull(), "missing").when(F.col("t_hash").isNull(), "unexpected").when(F.col("t_hash") != F.col("a_hash"), "content").when(F.col("t_mode") != F.col("a_mode"), "mode")
    files = both.select("tree", "path", problem.alias("problem")).where("problem is not null")
    folder = lambda d: d.select("tree", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("path")).distinct()
    gone = folder(tracked).join(folder(actual), ["tree", "path"], "left_anti").withColumn("problem", F.lit("directory_missing"))
    new = folder(actual).join(folder(tracked), ["tree", "path"], "left_anti").withColumn("problem", F.lit("directory_unexpected"))
    return files.unionByName(gone).unionByName(new)


def _grams(text: Column, n: int, blocks: bool) -> Column:
    """Distinct runs of ``n`` characters: those that follow one another as ``blocks``, or all, by a pattern that looks
    ahead."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(.{{{n}}})" if blocks else f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def contamination_tokens(files: DataFrame, tokens: DataFrame, shingle: int = 12, least: int = 5) -> DataFrame:
    """(doc_id, token_id): files that hold a token in their path or content, lower-cased or compacted (letters a-z and
    digits only).

    A lower-case hit is a compacted one too, so only tokens without a-z0-9 are searched in the lower-case text.
    Instead of testing every file for every token, a token of ``2 * shingle - 1`` characters or more gives its first
    ``shingle`` shingles, and a file cut into blocks of ``shingle`` characters its distinct blocks, as keys of an
    equi-join. Of a shorter token the first ``shingle`` characters (all of a shorter one, so there is one kind of key
    for each shorter length) are the key against all distinct shingles of a
    file, made within the task; hits are verified. Tokens of fewer than ``least`` characters are no tokens, as in the
    reference. ``files`` without a path are searched by content.
    """
    compact = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    keys = tokens.where(F.length("token") >= least).select("token_id", F.lower("token").alias("token"), compact("token").alias("c"))
    raw = F.col("c") == ""
    keys = keys.select("token_id", raw.alias("raw"), F.when(raw, F.col("token")).otherwise(F.col("c")).alias("sought"))
    # where a token of this length stands, one of the text's own blocks lies within it, at one of ``shingle`` offsets
    blocks = F.length("sought") >= 2 * shingle - 1
    at = F.explode(F.when(blocks, F.sequence(F.lit(1), F.lit(shingle))).otherwise(F.array(F.lit(1))))
    keys = keys.select("*", blocks.alias("blocks"), at.alias("at")).withColumn("k", F.substring(F.col("sought"), F.col("at"), F.lit(shingle))).withColumn("n", F.length("k"))
    parts = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in ("path", "content") if c in files.columns])
    rows = files.select("doc_id", F.explode(parts).alias("part"))
    rows = rows.select("doc_id", F.lower("part").alias("lower"), compact("part").alias("compacted"))
    # at most two kinds of text by ``shingle`` lengths, and blocks of both
    kinds = sorted((r.raw, r.blocks, r.n) for r in keys.select("raw", "blocks", "n").distinct().collect())
    if not kinds:
        return files.select("doc_id").where("false").crossJoin(tokens.select("token_id").where("false"))
    keyed = lambda raw, blocks, n: F.transform(_grams(F.col("lower" if raw else "compacted"), n, blocks), lambda g: F.struct(F.lit(raw).alias("raw"), F.lit(blocks).alias("blocks"), g.alias("k")))
    made = F.array(*[keyed(*kind) for kind in kinds])
    on = ["raw", "blocks", "k"]
    grams = rows.select("doc_id", F.inline(F.flatten(made)))
    near = keys.select(*on).distinct()
    near = grams.join(F.broadcast(near) if near.limit(100_001).count() <= 100_000 else near.hint("merge"), on, "left_semi")
    pairs = near.join(keys, on).select(F.col("doc_id").alias("id"), "token_id", "raw", "sought").distinct()
    hit = files.join(pairs.hint("merge"), files["doc_id"].eqNullSafe(F.col("id")))
    return hit.where(F.exists(parts, lambda p: F.when(F.col("raw"), F.lower(p)).otherwise(compact(p)).contains(F.col("sought")))).select("doc_id", "token_id")


#: Extensions that a text tree must not hold, and first bytes of common binary formats.
EXTENSIONS = "png jpg jpeg gif webp avif bmp ico svg pdf zip gz tar mp4 webm mov mp3 wav woff woff2 ttf otf".split()
MAGIC = {"png": "89504E47", "jpeg": "FFD8FF", "gif": "47494638", "webp": "52494646", "pdf": "25504446", "zip": "504B0304", "gzip": "1F8B", "woff": "774F4646", "woff2": "774F4632", "bmp": "424D", "ico": "00000100", "mp4": "0000002066747970", "ttf": "0001000000"}


def contamination_scan(files: DataFrame, most_bytes: int = 5 << 20) -> DataFrame:
    """(kind, n_files): forbidden extensions, binary signatures, NUL bytes, embedded images, oversized files, by the
    lists that its SQL has; ``contamination_findings`` is the whole scan."""
    head = F.hex(F.substring(F.col("content").cast("binary"), 1, 12))
    signature = F.lit(False)
    for magic in MAGIC.values():
        signature = signature | head.startswith(magic)
    flags = {
        "extension": F.lower(F.regexp_extract("path", "[.]([A-Za-z0-9]+)$", 1)).isin(*EXTENSIONS),
        "signature": signature,
        "nul_byte": F.col("content").contains("\u0000"),
        "data_uri": F.col("content").contains("data:image"),
        "base64_image": F.col("content").rlike("iVBORw0KGgo|/9j/4AAQ|R0lGODlh"),
        "oversize": F.octet_length("content") > most_bytes,
        "symbols": F.regexp_count("content", F.lit("[#*$%&|<>]")) > 20,
        # tried at the begins of lines only: elsewhere each place would be read up to the end of its line
        "long_line": F.col("content").rlike("(?:^|\n)[^\n]{1000}"),
    }
    kinds = files.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))).alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n_files"))


#: Fixed values of the whole scan: extensions, first bytes (patterns over their hex digits), names of generated folders,
#: begins of encoded images, an image within an address. White space is that of JavaScript.
ASSETS = "avif bmp eot gif heic ico jpeg jpg mov mp4 otf pdf png tar tif tiff ttf webm webp woff woff2 zip".split()
SIGNATURES = [
    ("png", "89504E470D0A1A0A"),
    ("jpeg", "FFD8FF"),
    ("gif", "474946383[79]61"),
    ("webp", "52494646.{8}57454250"),
    ("pdf", "255044462D"),
    ("zip", "504B0[357]0[468]"),
    ("woff", "774F46(?:46|32)"),
    ("opentype", "4F54544F"),
    ("truetype", "00010000"),
    ("bmp", "424D"),
    ("tiff", "(?:49492A00|4D4D002A)"),
    ("ico", "00000[12]00"),
    ("iso-media", ".{8}66747970"),
]
GENERATED = "candidate-inspection candidate-self captures comparison fidelity-series screenshots snapshot-assets source-candidate source-contract source-self test-results".split()
ENCODED = ["iVBORw0KGgo", "/9j/4AAQSkZJRg", "R0lGODlh", "R0lGODdh"]
SPACE = r"\x09-\x0D \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Possessive, so that parameters neither branch nor recurse; each begins at its own semicolon, which takes the same texts.
DATA_URI = "[Dd][Aa][Tt][Aa]S*+:S*+[Ii][Mm][Aa][Gg][Ee]S*+/S*+[A-Za-z0-9.+-]++(?:S*+;[^,;S]*+)*+S*+,".replace("[^,;S]", f"[^,;{SPACE}]").replace("S*+", f"[{SPACE}]*+")
SKIPPED = r"(?:^|/)(?:node_modules|[.]git)(?:/|\z)"
SUFFIX = r"[^/][.]([^./]*)\z"


def _entries(files: DataFrame) -> DataFrame:
    """(tree, path, content, regular, n_bytes) of the files of a scan, those below skipped folders left out."""
    rows = files.select("tree", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("mode", F.lit("100644")).alias("mode"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"))
    return rows.where(~F.col("path").rlike(SKIPPED)).select("*", F.col("mode").startswith("100").alias("regular"), F.octet_length("content").cast("long").alias("n_bytes"))


def contamination_findings(files: DataFrame, tokens: DataFrame, most_bytes: int = 5 << 20, manifest: str = "evals/targets.json") -> DataFrame:
    """``files(tree, path, mode, content)`` to (tree, path, kind, location, detail, n): the whole contamination scan.

    Paths of files and of the folders that they imply are searched for tokens, folders for names of generated ones, files
    for extensions; links and other entries are findings by their mode. Contents of more than ``most_bytes`` are a
    finding and are not looked into; others are searched for tokens (but for the ``manifest``, which lists them), first
    bytes, NUL bytes, images in addresses and encoded images. ``detail`` has the token's id, extension, bytes, format or
    begin; ``n`` counts the addresses, all of them, and is 1 elsewhere.
    """
    rows = _entries(files)
    parts = F.split("path", "/")
    folders = rows.select("tree", F.explode(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))).alias("path")).distinct()
    key = F.struct("tree", "path").alias("doc_id")
    whole = F.col("regular") & (F.col("n_bytes") <= most_bytes)
    finding = lambda when, kind, location, detail, n=F.lit(1): F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(location).alias("location"), detail.alias("detail"), n.cast("long").alias("n")))
    first = lambda pairs: F.coalesce(*[F.when(c, F.lit(k)) for k, c in pairs])

    suffix = F.lower(F.regexp_extract("path", SUFFIX, 1))
    head = F.hex(F.substring(F.col("content").cast("binary"), 1, 12))
    magic = F.when(F.length(head) >= 8, first((k, head.rlike(f"^{p}")) for k, p in SIGNATURES))
    encoded = first((p, F.col("content").contains(p)) for p in ENCODED)
    images = F.regexp_count("content", F.lit(DATA_URI))
    none = F.lit("")
    at_path = [
        finding(F.col("mode").startswith("120"), "symlink", "path", none),
        finding(~F.col("regular") & ~F.col("mode").startswith("120"), "unsupported-entry", "path", F.col("mode")),
        finding(F.col("regular") & suffix.isin(*ASSETS), "prohibited-asset-extension", "path", suffix),
        finding(F.col("regular") & (F.col("n_bytes") > most_bytes), "file-too-large", "content", F.col("n_bytes").cast("string")),
    ]
    within = [
        finding(whole & magic.isNotNull(), "prohibited-binary-magic", "content", magic),
        finding(whole & F.col("content").contains("\u0000"), "unexpected-binary-content", "content", none),
        finding(whole & (images > 0), "embedded-image-data-uri", "content", none, images),
        finding(whole & encoded.isNotNull(), "base64-image-signature", "content", encoded),
    ]
    found = rows.select("tree", "path", F.inline(F.array_compact(F.array(*at_path, *within))))
    made = folders.where(F.lower(F.element_at(parts, -1)).isin(*GENERATED)).select("tree", "path", F.inline(F.array(finding(F.lit(True), "prohibited-generated-directory", "path", none))))
    named = contamination_tokens(folders.union(rows.select("tree", "path")).distinct().select(key, "path"), tokens)
    held = contamination_tokens(rows.where(whole & (F.col("path") != manifest)).select(key, "content"), tokens)
    for hits, location in ((named, "path"), (held, "content")):
        found = found.union(hits.select("doc_id.tree", "doc_id.path", F.lit("benchmark-token"), F.lit(location), F.col("token_id").cast("string"), F.lit(1).cast("long")))
    return found.union(made)


def contamination_verdict(files: DataFrame, findings: DataFrame, most_bytes: int = 5 << 20) -> DataFrame:
    """(tree, n_files, n_bytes, n_findings, passed): files and bytes that a scan has looked into, and whether nothing was
    found."""
    rows, none = _entries(files), F.lit(0).cast("long")
    regular = F.col("regular").cast("long")
    seen = rows.select("tree", regular.alias("n_files"), F.when(F.col("regular") & (F.col("n_bytes") <= most_bytes), F.col("n_bytes")).otherwise(none).alias("n_bytes"), none.alias("n_findings"))
    # every tree has its row, one that is skipped as a whole too
    empty = files.select("tree", none, none, none)
    per = seen.union(empty).union(findings.select("tree", none, none, F.col("n"))).groupBy("tree").agg(*[F.sum(c).alias(c) for c in ("n_files", "n_bytes", "n_findings")])
    return per.withColumn("passed", F.col("n_findings") == 0)


def retention_audit(records: DataFrame) -> DataFrame:
    """(seq, values, keys): records whose stored JSON still holds a synthetic value or a value-bearing key."""
    values = F.regexp_extract_all("json", F.lit("synthetic-[0-9]+"), F.lit(0))
    keys = F.filter(F.regexp_extract_all("json", F.lit("\"([A-Za-z_]+)\" *:"), F.lit(1)), lambda k: k.isin("value", "text", "idem_key", "password"))
    out = records.select("seq", F.size(values).cast("long").alias("n_values"), F.array_join(F.array_sort(F.array_distinct(keys)), ",").alias("keys"))
    return out.where("n_values > 0 or keys <> ''")
