"""Credentials and personal data that values carry at any depth: JSON, parameters, addresses and fragments in one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import bound

#: Words and joined words that make a key sensitive, the form of a credential, and the limits.
KEY_WORDS = (
    "auth", "authorization", "credential", "credentials", "csrf", "jwt", "password",
    "secret", "session", "signature", "sitekey", "token",
)
KEY_PARTS = (
    "accesstoken", "apikey", "authtoken", "bearertoken", "clientsecret", "refreshtoken",
    "samlresponse", "sessionid", "sessiontoken", "signedtoken",
)
CREDENTIAL = (
    "(?i)(?:^|[^a-z0-9])(?:bearer\\s+[a-z0-9._~+/=-]{8,}|sk_(?:live|test)_[a-z0-9]{8,}|gh[pousr]_[a-z0-9]{8,}|akia[a-z0-9]{12,}"
    "|eyj[a-z0-9_-]{8,}\\.[a-z0-9_-]{8,}\\.[a-z0-9_-]{8,})(?:$|[^a-z0-9])"
)
DEEPEST, LONGEST, DECODINGS = 8, 64 * 1024, 4
#: Keys that hold an applicant's data, keys of that kind that are allowed, and the synthetic values.
VALUE_KEYS = "(?i)(?:applicant|answers?|fields?|values?|payload|resume|phone|full_?name|raw_?body|email)"
ALLOWED_KEYS = ("bodyBytes", "emailConfirmation")
SYNTHETIC = "(?i)(?:Synthetic Applicant|synthetic\\.applicant@example\\.test|\\+15555550100|example\\.test/portfolio|synthetic-resume\\.pdf)"

_KEYED = "(?i)(?:^|[?&#;,\\s{\\[(])['\"]?([a-z0-9_.-]{2,80})['\"]?\\s*[=:]"
_ADDRESS = "(?i)^(?:https?://|/|\\.\\.?/|\\?)"
_ABSOLUTE = "(?i)(https?://[^\\s\"'<>}\\]]+)"
_RELATIVE = "(?:^|[\\s=(\"'])(//[^\\s\"'<>}\\]]+)"
_ITEM = "struct<depth:int,text:string,parsed:boolean>"
_FOUND = "struct<depth:int,reason:string>"


def decodings(text: Column) -> Column:
    """The text and what percent-decoding makes of it, again and again while it changes; one form more than
    ``DECODINGS`` + 1 says that it would go on."""

    def further(forms: Column, _: Column) -> Column:
        last = F.element_at(forms, -1)
        following = F.coalesce(F.try_url_decode(last), last)
        return bound(following, lambda x: F.when(x == last, forms).otherwise(F.concat(forms, F.array(x))))

    return F.aggregate(F.sequence(F.lit(0), F.lit(DECODINGS)), F.array(text), further)


def sensitive_key(key: Column) -> Column:
    """Whether a key, in any decoding, names a credential; so does one that is encoded too often."""

    def named(form: Column) -> Column:
        words = F.lower(F.regexp_replace(form, "([a-z0-9])([A-Z])", "$1 $2"))
        whole = words.rlike("(?:^|[^a-z0-9])(?:" + "|".join(KEY_WORDS) + ")(?:$|[^a-z0-9])")
        return whole | F.regexp_replace(words, "[^a-z0-9]+", "").rlike("|".join(KEY_PARTS))

    return bound(decodings(key), lambda forms: (F.size(forms) > DECODINGS + 1) | F.exists(forms, named))


def _parameters(text: Column) -> Column:
    """(key, text) of a query string, decoded once."""

    def pair(part: Column) -> Column:
        plain = lambda c: F.coalesce(F.try_url_decode(c), c)
        return F.struct(plain(F.substring_index(part, "=", 1)).alias("key"), plain(F.regexp_extract(part, "(?s)^[^=]*=(.*)$", 1)).alias("text"))

    return F.transform(F.filter(F.split(F.regexp_replace(text, "^[?#]", ""), "&"), lambda p: p != ""), pair)


def _json_entries(text: Column) -> Column:
    """(key, text, parsed, kept) of a JSON object or array: strings as they are, objects and arrays as JSON (parsed), other
    scalars without a text; ``kept`` tells values from nulls and empty strings. Null if the text is no JSON."""

    def entry(key: Column, value: Column) -> Column:
        kind = F.schema_of_variant(value)
        string = F.try_variant_get(value, "$", "string")
        inner = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        shown = F.when(kind == "STRING", string).when(inner, F.to_json(value))
        # An empty array has no text of its own, so a key does not carry anything in it.
        kept = (kind != "VOID") & ~F.coalesce((kind == "STRING") & (string == ""), F.lit(False)) & ~(kind.startswith("ARRAY") & (F.to_json(value) == "[]"))
        return F.struct(key.alias("key"), shown.alias("text"), inner.alias("parsed"), kept.alias("kept"))

    def entries(v: Column) -> Column:
        pairs = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        objects = F.transform(pairs, lambda e: entry(e["key"], e["value"]))
        arrays = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: entry(F.lit(None).cast("string"), x))
        return F.coalesce(objects, arrays)

    return F.when(text.rlike("^[\\[{]"), bound(F.try_parse_json(text), entries))


def _looked_into(item: Column) -> Column:
    """(found, inner) of one item: what it shows by itself, and the items that it holds."""
    depth = item["depth"]
    none, nothing = F.array().cast(f"array<{_FOUND}>"), F.array().cast(f"array<{_ITEM}>")

    def finding(test: Column, reason: str, at: Column = depth) -> Column:
        return F.when(test, F.struct(at.cast("int").alias("depth"), F.lit(reason).alias("reason")))

    def below(by: int | Column, text: Column, parsed: Column = F.lit(False)) -> Column:
        return F.struct((depth + by).cast("int").alias("depth"), text.alias("text"), parsed.alias("parsed"))

    def of_json(entries: Column) -> Column:
        # A text holds a container one level down, and the container its entries one level below.
        by = F.when(item["parsed"], 1).otherwise(2)
        lowest = F.when(F.size(entries) > 0, depth + by).otherwise(depth + by - 1)
        found = F.array(
            finding(F.exists(entries, lambda e: e["kept"] & e["key"].isNotNull() & sensitive_key(e["key"])), "key"),
            finding(lowest > DEEPEST, "too_deep", F.lit(DEEPEST + 1)),
        )
        inner = F.transform(F.filter(entries, lambda e: e["text"].isNotNull()), lambda e: below(by, e["text"], e["parsed"]))
        return F.when(entries.isNull(), F.struct(none.alias("found"), nothing.alias("inner"))).otherwise(F.struct(found.alias("found"), inner.alias("inner")))

    def of_addresses(text: Column) -> Column:
        whole = F.when(text.rlike(_ADDRESS), F.array(text)).otherwise(F.array().cast("array<string>"))
        addresses = F.array_distinct(F.concat(whole, F.regexp_extract_all(text, F.lit(_ABSOLUTE), F.lit(1)), F.regexp_extract_all(text, F.lit(_RELATIVE), F.lit(1))))

        def parts(all_: Column) -> Column:
            queries = F.transform(all_, lambda u: F.regexp_extract(u, "(?s)^[^?#]*\\?([^#]*)", 1))
            queries = F.concat(F.when(text.contains("="), F.array(text)).otherwise(F.array().cast("array<string>")), queries)
            hashes = F.filter(F.transform(all_, lambda u: F.regexp_extract(u, "(?s)^[^#]*#(.*)$", 1)), lambda h: h != "")
            user = F.exists(all_, lambda u: u.rlike("(?i)^(?:https?:)?//[^/?#]*[^/?#:@][^/?#]*@"))
            broken = F.exists(all_, lambda u: u.rlike("(?i)^(?:https?:)?//(?:[^/?#]*@)?(?:[:/?#]|$)|^(?:https?:)?//[^/?#\\[]*:[0-9]*[^0-9/?#@][^/?#@]*(?:[/?#]|$)"))

            def result(p: Column) -> Column:
                values = F.concat(F.transform(p, lambda x: x["text"]), hashes)
                found = F.array(
                    finding(user, "userinfo"),
                    finding(broken, "bad_address"),
                    finding(F.exists(p, lambda x: (x["text"] != "") & sensitive_key(x["key"])), "key"),
                    finding((F.size(values) > 0) & (depth + 1 > DEEPEST), "too_deep", F.lit(DEEPEST + 1)),
                )
                return F.struct(found.alias("found"), F.transform(values, lambda v: below(1, v)).alias("inner"))

            return bound(F.flatten(F.transform(queries, _parameters)), result)

        return bound(addresses, parts)

    def of_form(text: Column) -> Column:
        keyed = F.exists(F.array_distinct(F.regexp_extract_all(text, F.lit(_KEYED), F.lit(1))), sensitive_key)
        own = F.array(finding(text.rlike(CREDENTIAL), "credential"), finding(keyed, "key"))
        both = F.struct(of_addresses(text).alias("a"), bound(_json_entries(text), of_json).alias("j"))
        return bound(both, lambda b: F.struct(F.concat(own, b["a"]["found"], b["j"]["found"]).alias("found"), F.concat(b["a"]["inner"], b["j"]["inner"]).alias("inner")))

    def of_text(forms: Column) -> Column:
        texts = F.filter(F.transform(F.slice(forms, 1, DECODINGS + 1), lambda x: F.btrim(x, F.lit(" \t\n\r\f\u00a0\ufeff"))), lambda x: x != "")
        results = F.transform(F.array_distinct(texts), of_form)
        more = F.array(finding(F.size(forms) > DECODINGS + 1, "encoding"))
        return bound(results, lambda r: F.struct(F.concat(more, F.flatten(r["found"])).alias("found"), F.flatten(r["inner"]).alias("inner")))

    long = F.struct(F.array(finding(F.lit(True), "too_long")).alias("found"), nothing.alias("inner"))
    text = item["text"]
    inside = F.when(item["parsed"], bound(_json_entries(text), of_json)).otherwise(bound(decodings(text), of_text))
    return F.when(~item["parsed"] & (F.length(text) > LONGEST), long).otherwise(inside)


def carrier_findings(values: DataFrame, *keys: str) -> DataFrame:
    """(``keys``..., depth, reason): values of column ``value`` that carry credentials, with the reason that lies least
    deep (ties by name). Never the value itself.

    A value is looked into in all its decodings: JSON, parameters, addresses and fragments are items one level below it,
    JSON within JSON likewise. A credential, a sensitive key with a value, an address with a user or none that can be read
    are findings; so is what can't be judged (``too_long``, ``too_deep``, ``encoding``), as nothing may pass unread. Levels
    are a fold within the row: no shuffle, no Python. Null and empty values carry nothing; repeated rows are judged alike.
    """
    state = f"struct<found:array<{_FOUND}>,work:array<{_ITEM}>>"
    whole = F.struct(F.lit(0).alias("depth"), F.col("value").alias("text"), F.lit(False).alias("parsed"))
    start = F.struct(F.array().alias("found"), F.array(whole).alias("work")).cast(state)

    def level(before: Column, _: Column) -> Column:
        def result(steps: Column) -> Column:
            below = F.filter(F.flatten(steps["inner"]), lambda x: (x["depth"] <= DEEPEST) & (x["text"] != ""))
            return F.struct(F.concat(before["found"], F.array_compact(F.flatten(steps["found"]))).alias("found"), F.array_distinct(below).alias("work")).cast(state)

        return bound(F.transform(before["work"], _looked_into), result)

    levels = F.aggregate(F.sequence(F.lit(0), F.lit(DEEPEST)), start, level)
    # A generator keeps the fold from being computed again in a filter.
    first = F.inline_outer(F.array_compact(F.array(F.array_min(levels["found"]))))
    return values.where("value <> ''").select(*keys, first).where("reason is not null")


def retained_data(records: DataFrame, *keys: str) -> DataFrame:
    """(``keys``..., reason, n): records whose column ``json`` still holds a synthetic value (``value``), a key of an
    applicant's data at any depth but for the allowed ones (``key``, counted), or no readable JSON (``broken``).

    The text is parsed to a VARIANT and written out again, so that escapes are resolved and strings can't be mistaken for
    keys; then one pass over its string tokens gives the keys of all levels, however deep. Null: nothing stored, no finding.
    """
    stored = records.where("json is not null").select(*keys, F.col("json").alias("__json"), F.to_json(F.try_parse_json("json")).alias("__parsed"))
    # Without escape pairs, every quotation mark begins or ends a string.
    tokens = F.regexp_extract_all(F.regexp_replace("__parsed", "\\\\.", "\ufffd"), F.lit('"[^"]*":?'), F.lit(0))
    named = F.transform(F.filter(tokens, lambda t: t.endswith(":")), lambda t: F.substring(t, F.lit(2), F.length(t) - 3))
    held = F.filter(named, lambda k: ~k.isin(*ALLOWED_KEYS) & k.rlike(VALUE_KEYS))
    reasons = F.array(
        F.struct(F.lit("broken").alias("reason"), F.when(F.col("__parsed").isNull(), 1).otherwise(0).cast("long").alias("n")),
        F.struct(F.lit("key").alias("reason"), F.coalesce(F.size(held), F.lit(0)).cast("long").alias("n")),
        F.struct(F.lit("value").alias("reason"), F.regexp_count(F.coalesce("__parsed", "__json"), F.lit(SYNTHETIC)).cast("long").alias("n")),
    )
    return stored.select(*keys, F.inline(reasons)).where("n > 0")
