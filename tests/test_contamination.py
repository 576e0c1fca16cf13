"""The whole contamination scan: tokens, folders, links, signatures, encoded images, size and verdict."""

import __spark_entry__ as entry
from pagegauge.operators import corpus
from test_sql_rules import both

FILES = "tree string, path string, mode string, content string"
TOKENS = "token_id long, token string"


def scan(spark, rows, tokens=(), **more):
    files = spark.createDataFrame(rows, FILES)
    found = corpus.contamination_findings(files, spark.createDataFrame(list(tokens), TOKENS), **more)
    return files, found


def test_every_step_of_the_scan_finds(spark):
    rows = [
        ("t", "skill/acme-site/notes.md", "100644", "fine"),
        ("t", "skill/acme-site/more.md", "100644", "the ACME Site"),
        ("t", "a/Captures/x/y.txt", "100644", ""),
        ("t", "a/captures", "100644", ""),
        ("t", "a/link", "120000", "R0lGODdh"),
        ("t", "a/module", "160000", None),
        ("t", "a/x.TIFF", "100644", ""),
        ("t", "a/.png", "100644", ""),
        ("t", "a/b.svg", "100644", "acme"),
        ("t", "a/zip.txt", "100644", "PK\u0005\u0006"),
        ("t", "a/nul.txt", "100644", "a\u0000b"),
        ("t", "a/uri.txt", "100644", "DATA :\nimage / svg+xml;charset=x ;base64 , data:image/png; a, data:image/png, data:image/png x, data:images,"),
        ("t", "a/code.txt", "100644", "see R0lGODdh"),
        ("t", "a/large.txt", "100644", "acme site GIF89a R0lGODlh" * 40),
        ("t", "evals/targets.json", "100644", "acme site"),
        ("t", "node_modules/acme-site/a.png", "100644", "acme site"),
        ("t", "a/.git/acme-site", "100644", "acme site"),
        ("u", "a/b.txt", "100755", "fineé"),
        ("v", ".git/a.png", "100644", "BM"),
    ]
    files, found = scan(spark, rows, [(1, "Acme Site"), (2, "acme")], most_bytes=500)
    assert {(r.path, r.kind, r.location, r.detail, r.n) for r in found.collect()} == {
        ("skill/acme-site", "benchmark-token", "path", "1", 1),
        ("skill/acme-site/notes.md", "benchmark-token", "path", "1", 1),
        ("skill/acme-site/more.md", "benchmark-token", "path", "1", 1),
        ("skill/acme-site/more.md", "benchmark-token", "content", "1", 1),
        ("a/Captures", "prohibited-generated-directory", "path", "", 1),
        ("a/link", "symlink", "path", "", 1),
        ("a/module", "unsupported-entry", "path", "160000", 1),
        ("a/x.TIFF", "prohibited-asset-extension", "path", "tiff", 1),
        ("a/zip.txt", "prohibited-binary-magic", "content", "zip", 1),
        ("a/nul.txt", "unexpected-binary-content", "content", "", 1),
        ("a/uri.txt", "embedded-image-data-uri", "content", "", 2),
        ("a/code.txt", "base64-image-signature", "content", "R0lGODdh", 1),
        ("a/large.txt", "file-too-large", "content", "1000", 1),
    }
    verdict = {r.tree: tuple(r)[1:] for r in corpus.contamination_verdict(files, found, 500).collect()}
    assert verdict["u"] == (1, 6, 0, True) and verdict["v"] == (0, 0, 0, True)
    assert verdict["t"][0] == 13 and verdict["t"][2:] == (14, False)


def test_all_signatures_are_known_and_the_first_is_named(spark):
    heads = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FFE0", "gif": "474946383761", "webp": "524946460102030457454250", "pdf": "255044462D", "zip": "504B0708", "woff": "774F4632", "opentype": "4F54544F", "truetype": "00010000", "bmp": "424D2020", "tiff": "4D4D002A", "ico": "00000200", "iso-media": "0102030466747970"}
    heads |= {"short": "424D20", "riff": "524946460102030457415645", "gzip": "1F8B0800", "png head": "89504E470D0A1A00"}
    rows = spark.createDataFrame([("t", k, "100644", bytearray.fromhex(v)) for k, v in heads.items()], "tree string, path string, mode string, content binary")
    found = corpus.contamination_findings(rows, spark.createDataFrame([], TOKENS)).where("kind = 'prohibited-binary-magic'")
    assert {(r.path, r.detail) for r in found.collect()} == {(k, k) for k, _ in corpus.SIGNATURES}


def test_many_parameters_of_an_address_neither_branch_nor_recurse(spark):
    rows = [("t", "a", None, "data:image/png" + ";a" * 50_000 + ","), ("t", "b", None, "data:image/png" + ";" * 50_000 + " x")]
    _, found = scan(spark, rows)
    assert [(r.path, r.n) for r in found.collect()] == [("a", 1)]


def test_queries_and_their_sql_agree_on_contaminated_rows(spark, tmp_path):
    texts = ["plain", "", None, "BMW drives", "%PDF-1.7", "abcdftyp", "GIF89a", "OTTOman", "RIFF....WEBP", "a\u0000b", "data:image/png;base64,AAAA data :image/gif,", "data:image/png;;;a b,", "x /9j/4AAQSkZJRg", "/9j/4AAQ",
             "What is 12 times 37?", "what-is 12 TIMES 37 or so", "東京タワー駅", "x" * (5 << 20), "x" * (5 << 20) + "BM what is 12 times 37?"]
    sources = ["web", "Captures", "node_modules", "x/.git", "screenshots/deep", None, "what is 12 times 37"]
    docs = [(i, t, lang, s, 0) for i, (t, s, lang) in enumerate((t, s, lang) for t in texts for s in (sources if len(t or "") < 100 else sources[:1]) for lang in ("en", "a.b"))]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(1, "What is 12 times 37?"), (2, "東京タワー"), (3, "abc"), (4, None)], "item_id long, text string")
    got, want = both(spark, str(tmp_path), "contamination_findings", documents=docs, benchmark=bench)
    assert got == want and len({r[1] for r in got}) == 7
    assert {tuple(r) for r in map(tuple, entry.queries()["contamination_verdict"](spark, str(tmp_path)).select("passed").distinct().collect())} == {(True,), (False,)}


def test_verdict_and_its_sql_agree(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, (s, t) in enumerate([("web", "fine"), ("web", "BMW drives"), ("book", "fine"), (None, "fine"), (".git", "BMW drives"), ("book", None)])], "doc_id long, text string, lang string, source string, n_chars long")
    got, want = both(spark, str(tmp_path), "contamination_verdict", documents=docs, benchmark=spark.createDataFrame([(1, "drives")], "item_id long, text string"))
    assert got == want and len(got) == 4
