"""Carriers and retained data against plain recursion."""

import json
import re
from urllib.parse import quote, unquote_plus

import numpy as np
import pytest

from pagegauge.operators import carriers as K


def forms(text):
    out = [text]
    while len(out) <= K.DECODINGS + 1 and re.fullmatch("(?s)(?:[^%]|%[0-9a-fA-F]{2})*", out[-1]) and unquote_plus(out[-1]) != out[-1]:
        out.append(unquote_plus(out[-1]))
    return out


def sensitive(key):
    if len(forms(key)) > K.DECODINGS + 1:
        return True
    for form in forms(key):
        parts = re.findall("[a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", form).lower())
        if set(parts) & set(K.KEY_WORDS) or any(k in "".join(parts) for k in K.KEY_PARTS):
            return True
    return False


def carries(value, depth=0):
    """Least (depth, reason) of what a JSON value or a text carries."""
    if depth > K.DEEPEST:
        return {(K.DEEPEST + 1, "too_deep")}
    found = set()
    if isinstance(value, list):
        for x in value:
            found |= carries(x, depth + 1)
    elif isinstance(value, dict):
        for k, x in value.items():
            found |= carries(x, depth + 1) | ({(depth, "key")} if sensitive(k) and x not in (None, "", []) else set())
    elif isinstance(value, str):
        if len(value) > K.LONGEST:
            return {(depth, "too_long")}
        every = forms(value)
        if len(every) > K.DECODINGS + 1:
            found.add((depth, "encoding"))
        for text in {x.strip() for x in every[: K.DECODINGS + 1]} - {""}:
            if re.search(K.CREDENTIAL, text):
                found.add((depth, "credential"))
            if any(map(sensitive, re.findall(K._KEYED, text))):
                found.add((depth, "key"))
            try:
                inner = json.loads(text) if text[0] in "[{" else None
            except ValueError:
                inner = None
            if inner is not None:
                # A key of a container counts where the container's text stands.
                found |= {(depth if f[1] == "key" and f[0] == depth + 1 else f[0], f[1]) for f in carries(inner, depth + 1)}
            urls = ([text] if re.match(K._ADDRESS, text) else []) + re.findall(K._ABSOLUTE, text) + re.findall(K._RELATIVE, text)
            queries = [text.lstrip("?#")] if "=" in text else []
            for u in urls:
                if re.match("(?i)(?:https?:)?//[^/?#]+@", u):
                    found.add((depth, "userinfo"))
                bare, _, part = u.partition("#")
                queries.append(bare.partition("?")[2])
                if part:
                    found |= carries(part, depth + 1)
            for pair in "&".join(queries).split("&"):
                if pair:
                    k, _, v = pair.partition("=")
                    found |= carries(unquote_plus(v), depth + 1) | ({(depth, "key")} if v and sensitive(unquote_plus(k)) else set())
    return found


def made(rng, depth):
    """A random value: JSON, parameters, addresses and encodings in one another, now and then with a sensitive key."""
    key = ["a", "size", "n_1", "x.y", "accessToken", "client-secret", "sessions"][int(rng.integers(0, 100)) % 7 if rng.random() < 0.12 else int(rng.integers(0, 4))]
    if depth == 0 or rng.random() < 0.15:
        return ["plain", "a b", "", "7", "Bearer abcdefgh1", "-"][int(rng.integers(0, 6)) if rng.random() < 0.1 else 0]
    inner, kind = made(rng, depth - 1), int(rng.integers(0, 6))
    if kind == 0:
        return json.dumps({key: inner, "b": [None, 1, {"c": inner}]})
    if kind == 1:
        return f"x=1&{key}={quote(inner, safe='')}"
    if kind == 2:
        return f"https://h.example/p?{key}={quote(inner, safe='')}#z"
    if kind == 3:
        return f"/p#{quote(inner, safe='')}"
    return quote(inner, safe="") if kind == 4 else json.dumps([[inner]])


def test_random_values(spark):
    rng = np.random.default_rng(5)
    values = [made(rng, int(rng.integers(1, 7))) for _ in range(400)]
    got = {r.i: (r.depth, r.reason) for r in K.carrier_findings(spark.createDataFrame(list(enumerate(values)), "i long, value string"), "i").collect()}
    want = {i: min(f) for i, f in enumerate(map(carries, values)) if f}
    assert len(want) > 40 and len(want) < 390
    assert {i: (values[i], got.get(i), want.get(i)) for i in got.keys() | want.keys() if got.get(i) != want.get(i)} == {}


def nested(x, levels):
    for _ in range(levels):
        x = {"a": x}
    return x


@pytest.mark.parametrize(
    "value,found",
    [
        (json.dumps(nested({"accessToken": "z"}, 5)), "key"),
        ('{"\\u0074oken":"x"}', "key"),
        ('{"\\u0074oken":""}', None),
        ('{"\\u0074oken":null}', None),
        (json.dumps(nested(1, 8)), "too_deep"),
        (json.dumps(nested(1, 7)), None),
        ("{token: 1", "key"),
        ("{broken", None),
        ("x" * (K.LONGEST + 1), "too_long"),
        ("x" * K.LONGEST, None),
        ("%252525252541", "encoding"),
        ("//u:p@h.example/", "userinfo"),
        ("https://h.example:8080/", None),
        ("https://h.example:x/", "bad_address"),
        ("https://", "bad_address"),
        ("", None),
        (None, None),
    ],
)
def test_values(spark, value, found):
    got = K.carrier_findings(spark.createDataFrame([(1, value)], "i long, value string"), "i").collect()
    assert [r.reason for r in got] == ([found] if found else [])


def test_tables(spark):
    one = spark.createDataFrame([(1, "?token=1", "x")] * 2, "i long, value string, depth string")
    assert [tuple(r) for r in K.carrier_findings(one, "i").collect()] == [(1, 0, "key")] * 2
    assert K.carrier_findings(one.limit(0), "i").count() == 0


def test_retained(spark):
    far = json.dumps(nested([{"Phone": 1}], 40))
    cases = [far, '{"bodyBytes":1,"emailConfirmation":false}', "{bad", None, '{"x":"\\"email\\":1"}', '{"\\u0065mail":"synthetic-resume.pdf"}', "", '"payload"', '{"a\\\\":{"values":{"fields":2}}}', '{"a":1,"a":2}']
    got = K.retained_data(spark.createDataFrame(list(enumerate(cases)), "seq long, json string"), "seq").collect()
    want = [(0, "key", 1), (2, "broken", 1), (5, "key", 1), (5, "value", 1), (6, "broken", 1), (8, "key", 2), (9, "broken", 1)]
    assert sorted(map(tuple, got)) == want
