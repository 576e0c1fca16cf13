"""Scalar column expressions used by the operators; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the web platform, which is more than \s in Java.
SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(c), SPACE, " "))


def round3(c) -> Column:
    """Three decimals, halves upwards."""
    return F.floor(col(c) * 1000 + 0.5) / 1000


def codes(pairs: dict[str, Column]) -> Column:
    """Names whose condition holds, in the given order; null conditions don't hold."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs.items()]))


def joined(c, sep: str = ",") -> Column:
    return F.array_join(col(c), sep)


def changed_fields(props: list[str], left: str = "b_", right: str = "c_") -> Column:
    """Names of the properties that differ between two sides; nulls are equal to each other."""
    return F.array_compact(F.array(*[F.when(~F.col(left + p).eqNullSafe(F.col(right + p)), F.lit(p)) for p in props]))


def value_class(length, kind) -> Column:
    """Class of a control's value from its length and type; never the value itself."""
    length, kind = col(length), col(kind)
    return F.when(length == 0, "empty").when(kind.isin("checkbox", "radio"), "choice").when(length <= 8, "short").when(length <= 32, "medium").otherwise("long")


def origin(url) -> Column:
    """Scheme, host and port of a URL, lower-case; the default port is left out. Null if there is no host."""
    url = col(url)
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([\\[][^\\]/?#]*[\\]]|[^/?#:@]+)", 1))
    port = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:[\\[][^\\]/?#]*[\\]]|[^/?#:@]+):([0-9]+)", 1)
    shown = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, shown))


def host(url) -> Column:
    return F.lower(F.regexp_extract(col(url), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([\\[][^\\]/?#]*[\\]]|[^/?#:@]+)", 1))


def path(url) -> Column:
    return F.regexp_extract(col(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def bound(value: Column, body) -> Column:
    """Bind ``value`` to a name, so that it is computed once a row and the expression doesn't grow with its uses."""
    return F.transform(F.array(value), body)[0]


def ipv4(c) -> Column:
    """Number of an IPv4 host as URLs are read: one to four parts, decimal, octal (0...) or hexadecimal (0x...), the last
    one filling what is left; full-width digits and stops count as plain ones. Null for anything else."""

    def number(part: Column) -> Column:
        digits = F.when(part == "0x", "0").when(part.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(part, 3, 64), 16, 10))
        return digits.when(part.rlike("^0[0-7]+$"), F.conv(part, 8, 10)).when(part.rlike("^(?:0|[1-9][0-9]*)$"), part).try_cast("long")

    def whole(n: Column) -> Column:
        head, last = F.slice(n, F.lit(1), F.size(n) - 1), F.element_at(n, -1)
        room = F.get(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1)]), F.size(n) - 1)
        ok = (F.size(n) <= 4) & F.forall(n, lambda x: x.isNotNull()) & F.forall(head, lambda x: x <= 255) & (last < room)
        return F.when(ok, F.aggregate(head, F.lit(0).cast("long"), lambda a, x: a * 256 + x) * room + last)

    plain = F.translate(F.lower(col(c)), "０１２３４５６７８９ａｂｃｄｅｆｘ．。", "0123456789abcdefx..")
    return bound(F.transform(F.split(F.regexp_replace(plain, "[.]$", ""), "[.]"), number), whole)


def ipv6(c) -> Column:
    """The eight words of an IPv6 address, in brackets or not, as numbers; null for anything else. A zone is cut off, a
    dotted quad at the end is two words."""

    def without_quad(text: Column) -> Column:
        quad = F.split(F.regexp_extract(text, "(?:^|:)([0-9]{1,3}(?:[.][0-9]{1,3}){3})$", 1), "[.]")

        def two_words(q: Column) -> Column:
            n = [F.get(q, F.lit(i)).try_cast("int") for i in range(4)]
            return F.when(F.forall(q, lambda x: x.try_cast("int") <= 255), F.concat(F.hex(n[0] * 256 + n[1]), F.lit(":"), F.hex(n[2] * 256 + n[3])))

        return F.when(~text.contains("."), text).otherwise(F.concat(F.regexp_replace(text, "[0-9.]+$", ""), bound(quad, two_words)))

    def words(text: Column) -> Column:
        sides = F.transform(F.split(text, "::"), lambda x: F.filter(F.split(x, ":"), lambda w: w != ""))

        def filled(s: Column) -> Column:
            left, right = F.get(s, F.lit(0)), F.get(s, F.lit(1))
            gap = F.lit(8) - F.size(left) - F.size(right)
            return F.when(F.size(s) == 1, left).when((F.size(s) == 2) & (gap >= 1), F.concat(left, F.array_repeat(F.lit("0"), gap), right))

        ok = text.contains(":") & ~text.rlike("^:[^:]|[^:]:$|:::")
        return F.when(ok, bound(sides, filled))

    def numbers(w: Column) -> Column:
        return F.when((F.size(w) == 8) & F.forall(w, lambda x: x.rlike("^[0-9a-fA-F]{1,4}$")), F.transform(w, lambda x: F.conv(x, 16, 10).cast("long")))

    text = F.regexp_replace(F.lower(col(c)), "^\\[|%[^\\]]*|\\]$", "")
    return bound(bound(bound(text, without_quad), words), numbers)


def decoded(c, levels: int = 4) -> Column:
    """Percent-decoded up to ``levels`` times; a malformed level stays as it was. A plus sign is no blank here."""
    out = col(c)
    for _ in range(levels):
        out = F.coalesce(F.try_url_decode(F.replace(out, F.lit("+"), F.lit("%2B"))), out)
    return out


def channel_luminance(c) -> Column:
    """sRGB channel (0 to 255) to linear light."""
    v = col(c) / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def luminance(r, g, b) -> Column:
    return 0.2126 * channel_luminance(r) + 0.7152 * channel_luminance(g) + 0.0722 * channel_luminance(b)


def yiq_delta(r1, g1, b1, r2, g2, b2) -> Column:
    """Squared perceptual distance of two opaque colours in YIQ space (Kotsarenko and Ramos, 2010)."""
    y = lambda r, g, b: col(r) * 0.29889531 + col(g) * 0.58662247 + col(b) * 0.11448223
    i = lambda r, g, b: col(r) * 0.59597799 - col(g) * 0.27417610 - col(b) * 0.32180189
    q = lambda r, g, b: col(r) * 0.21147017 - col(g) * 0.52261711 + col(b) * 0.31114694
    d = [f(r1, g1, b1) - f(r2, g2, b2) for f in (y, i, q)]
    return 0.5053 * d[0] * d[0] + 0.299 * d[1] * d[1] + 0.1957 * d[2] * d[2]
