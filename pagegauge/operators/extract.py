"""Extraction of typed records from stored HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.expressions import origin, path, squeeze
from ..sources.readers import arrow_schema, slices
from .markup import page_elements

CSS_URL = "url[(] *[\"']?([^\"')]+)[\"']? *[)]"
CSS_IMPORT = "@import +[\"']([^\"']+)[\"']"
CSS_SET = "image-set[(] *[\"']([^\"']+)[\"']"
GRADIENT = "(?:repeating-)?(?:linear|radial|conic)-gradient[(]"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


LINKS = "page_id long, viewport string, ordinal long, href string, url string, text string, aria_label string, target string, rel string"
INVENTORY = (
    "forms", "unsafe_forms", "navigable_links", "external_links", "unsafe_links", "scripts", "inline_scripts", "external_scripts", "stylesheet_links", "external_stylesheets",
    "base_elements", "iframes", "embedded_objects", "disclosures", "meta_refreshes", "svg_elements", "svg_external_resources",
)
#: What a safe form may use.
FORM_PATH, FORM_TYPES = "/api/applications", ("application/x-www-form-urlencoded", "multipart/form-data")


def site(url: str) -> tuple[str, str, int | None] | None:
    """(scheme, host, port) of a URL of any scheme, default ports left out; null if it is malformed."""
    try:
        u = urlsplit(url.strip())
        port = u.port
    except ValueError:
        return None
    if u.scheme in ("http", "https") and not u.hostname:
        return None
    return u.scheme, u.hostname or "", None if (u.scheme, port) in (("http", 80), ("https", 443)) else port


def target_class(raw: str | None, page: str) -> str:
    """same_origin, external, or unsafe (malformed, with credentials, no http) of an address seen from its page."""
    try:
        url = urljoin(page, (raw or "").strip())
        u = urlsplit(url)
    except ValueError:
        return "unsafe"
    own = site(url)
    if own is None or own[0] not in ("http", "https") or u.username or u.password:
        return "unsafe"
    return "same_origin" if own == site(page) else "external"


class _Links(HTMLParser):
    """One pass over a page: its anchors with their text, and the counts of its structural inventory."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.page = self.base = page
        self.based = False
        self.links: list[dict] = []
        self.open: dict | None = None
        self.raw: str | None = None
        self.n = dict.fromkeys(INVENTORY, 0)

    def resolved(self, href: str) -> str | None:
        try:
            return urljoin(self.base, href.strip())
        except ValueError:
            return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a: dict[str, str] = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        self.count(tag, a)
        self.raw = tag if tag in ("script", "style") else None
        if tag == "base" and "href" in a and not self.based:
            self.based, self.base = True, self.resolved(a["href"]) or self.base
        if tag == "a":
            # an anchor closes the one before, as anchors don't nest
            self.open = {"ordinal": len(self.links), "href": a.get("href"), "url": self.resolved(a["href"]) if "href" in a else "", "text": "", "aria_label": " ".join(a.get("aria-label", "").split()), "target": a.get("target", ""), "rel": a.get("rel", "")}
            self.links.append(self.open)

    def count(self, tag: str, a: dict[str, str]) -> None:
        n = self.n
        href = a.get("href", a.get("xlink:href"))
        if tag == "form":
            n["forms"] += 1
            n["unsafe_forms"] += not self.safe_form(a)
        elif tag in ("a", "area") and href is not None:
            kind = target_class(href, self.page)
            n["navigable_links"] += 1
            n["external_links"] += kind == "external"
            n["unsafe_links"] += kind == "unsafe"
        elif tag == "script":
            n["scripts"] += 1
            n["inline_scripts"] += "src" not in a
            n["external_scripts"] += "src" in a and target_class(a["src"], self.page) == "external"
        elif tag == "link" and "stylesheet" in a.get("rel", "").lower().split():
            n["stylesheet_links"] += 1
            n["external_stylesheets"] += target_class(a.get("href"), self.page) == "external"
        elif tag == "base":
            n["base_elements"] += 1
        elif tag == "iframe":
            n["iframes"] += 1
        elif tag in ("object", "embed"):
            n["embedded_objects"] += 1
        elif tag == "meta":
            n["meta_refreshes"] += a.get("http-equiv", "").strip().lower() == "refresh"
        elif tag == "svg":
            n["svg_elements"] += 1
        elif tag in ("use", "feimage"):
            n["svg_external_resources"] += bool((href or "").strip()) and not (href or "").strip().startswith("#")
        n["disclosures"] += "data-replica-disclosure" in a

    def safe_form(self, a: dict[str, str]) -> bool:
        action = (a.get("action") or "").strip() or self.page
        if target_class(action, self.page) != "same_origin":
            return False
        u = urlsplit(urljoin(self.page, action))
        method, kind, target = (a.get("method") or "get").lower(), (a.get("enctype") or FORM_TYPES[0]).lower(), a.get("target", "").lower()
        return u.path == FORM_PATH and not u.query and not u.fragment and method == "post" and kind in FORM_TYPES and target in ("", "_self")

    def handle_endtag(self, tag: str) -> None:
        self.raw = None
        if tag == "a":
            self.open = None

    def handle_data(self, data: str) -> None:
        if self.open is not None and self.raw is None:
            self.open["text"] += data


def _parsed(page: str | None, html: str | None) -> _Links:
    parser = _Links(page or "")
    parser.feed(html or "")
    parser.close()
    return parser


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, viewport, ordinal, href, url, text, aria_label, target, rel) of every anchor in document order.

    Attributes may stand in any order and quoting, text may be nested in other tags; white space is normalised. ``url``
    is ``href`` resolved against the page's base and address (null if malformed, empty without a href). A null page
    has no links.
    """
    schema = arrow_schema(LINKS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in slices(batches):
            rows = []
            for page in pages:
                links = _parsed(page["url"], page["html"]).links
                rows += [{"page_id": page["page_id"], "viewport": "default"} | r | {"text": " ".join(r["text"].split())} for r in links]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(work, LINKS)


def extract_headings(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, level, text) of every heading, nested tags included; an aria-level attribute goes before the
    tag's digit. A null page has none."""
    rows = page_elements(pages, frozenset(f"h{i}" for i in range(1, 7)))
    ordinal = F.row_number().over(W.partitionBy("page_id").orderBy("node")) - 1
    aria = F.regexp_extract(F.coalesce(F.col("attributes")["aria-level"], F.lit("")), "^ *([0-9]+) *$", 1)
    return rows.select("page_id", ordinal.cast("long").alias("ordinal"), F.when(aria != "", aria).otherwise(F.substring("tag", 2, 1)).cast("int").alias("level"), "text")


#: Kind of dependency: tag, attribute with its address (or content).
DEPENDENCIES = {"script": ("script", "src"), "stylesheet": ("link", "href"), "image": ("img", "src"), "base": ("base", "href"), "meta_refresh": ("meta", "content"), "frame": ("iframe", "src"), "object": ("object", "data")}


def extract_dependencies(pages: DataFrame) -> DataFrame:
    """(page_id, kind, ordinal, target) of scripts, stylesheets, images, base, refresh, frames and objects, however
    their attributes are written. Ordinals count a kind's elements on a page; a null page has none."""
    rows = page_elements(pages, frozenset(t for t, _ in DEPENDENCIES.values()))
    get = lambda n: F.col("attributes")[n]
    lower = lambda n: F.lower(F.coalesce(get(n), F.lit("")))
    fits = {"stylesheet": F.array_contains(F.split(F.trim(lower("rel")), "[ \\t\\r\\n]+"), "stylesheet"), "meta_refresh": F.trim(lower("http-equiv")) == "refresh"}
    kind, target = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (tag, attribute) in DEPENDENCIES.items():
        own = (F.col("tag") == tag) & get(attribute).isNotNull() & fits.get(name, F.lit(True))
        kind, target = F.when(own, name).otherwise(kind), F.when(own, get(attribute)).otherwise(target)
    rows = rows.select("page_id", "node", kind.alias("kind"), target.alias("target")).where("kind is not null")
    ordinal = F.row_number().over(W.partitionBy("page_id", "kind").orderBy("node")) - 1
    return rows.select("page_id", "kind", ordinal.cast("long").alias("ordinal"), "target")


#: Counts of tags and the like.
TAGS = {
    "links": "<a ", "forms": "<form", "scripts": "<script", "stylesheets": "<style|<link rel=\"stylesheet\"", "metas": "<meta ", "base": "<base ", "frames": "<iframe",
    "objects": "<object|<embed", "images": "<img", "headings": "<h[1-6]", "lists": "<ul|<ol", "items": "<li", "paragraphs": "<p>", "comments": "<!--", "svg": "<svg", "tables": "<table", "inline_handlers": " on[a-z]+=\"",
}


def tag_counts(pages: DataFrame) -> DataFrame:
    """(page_id, n_<thing>...): occurrences of 17 patterns per page."""
    return pages.select("page_id", *[F.size(_all(F.col("html"), p, 0)).cast("long").alias(f"n_{k}") for k, p in TAGS.items()])


def structural_inventory(pages: DataFrame) -> DataFrame:
    """(page_id, n_<thing>...): the counts of ``INVENTORY``; addresses are judged from the page's own. A null page
    counts nothing."""
    ddl = "page_id long, " + ", ".join(f"n_{k} long" for k in INVENTORY)
    schema = arrow_schema(ddl)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in slices(batches):
            rows = [{"page_id": page["page_id"]} | {f"n_{k}": int(v) for k, v in _parsed(page["url"], page["html"]).n.items()} for page in pages]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(work, ddl)


def page_profile(pages: DataFrame) -> DataFrame:
    """(page_id, title, lang, declared_charset, text_length) with white space normalised: the first title, the root's
    language and the first declared charset, however written, and the length of the text outside of tags, scripts,
    styles and the title."""
    rows = page_elements(pages, frozenset({"html", "title", "meta"}))
    get = lambda n: F.col("attributes")[n]
    first = lambda c, when: F.min(F.when(when & c.isNotNull(), F.struct("node", c.alias("v")))).getField("v")
    declared = rows.groupBy("page_id").agg(first(F.col("text"), F.col("tag") == "title").alias("title"), first(get("lang"), F.col("tag") == "html").alias("lang"), first(get("charset"), F.col("tag") == "meta").alias("declared_charset"))
    bare = F.regexp_replace("html", "(?is)<(script|style|title)\\b[^>]*>.*?</\\1[^>]*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, "<[^>]*>", " ")
    length = F.length(F.trim(F.regexp_replace(F.coalesce(bare, F.lit("")), "[ \t\r\n]+", " "))).cast("long")
    texts = pages.select("page_id", length.alias("text_length"))
    out = texts.join(declared.hint("shuffle_hash"), "page_id", "left")
    return out.select("page_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "lang", "declared_charset")], "text_length")


def css_dependencies(rows: DataFrame) -> DataFrame:
    """Distinct (page_id, url) of a CSS text: url(), @import and quoted image-set entries; no data URLs or bare
    fragments; fragments are cut."""
    found = F.array_union(F.array_union(_all(F.col("css"), CSS_URL), _all(F.col("css"), CSS_IMPORT)), _all(F.col("css"), CSS_SET))
    urls = rows.select("page_id", F.explode(found).alias("url"))
    urls = urls.where(~F.lower("url").startswith("data:") & ~F.col("url").startswith("#"))
    return urls.select("page_id", F.trim(F.regexp_replace("url", "#.*$", "")).alias("url")).where("url <> ''").distinct()


def generated_images(rows: DataFrame) -> DataFrame:
    """(page_id, n_gradients, n_paints, n_cross_fades, n_stops, complex) of a CSS text."""
    n = {k: F.size(_all(F.col("css"), p, 0)) for k, p in (("n_gradients", GRADIENT), ("n_paints", "paint[(]"), ("n_cross_fades", "cross-fade[(]"), ("n_stops", "(?:#[0-9a-fA-F]{3,8}|rgba?[(]|hsla?[(])"))}
    complex_ = (n["n_paints"] > 0) | (n["n_cross_fades"] > 0) | (n["n_gradients"] >= 2) | (n["n_stops"] >= 16) | (F.length("css") > 512)
    return rows.select("page_id", *[c.cast("long").alias(k) for k, c in n.items()], complex_.alias("complex"))


def url_provenance(pages: DataFrame) -> DataFrame:
    """(page_id, location, sha256, query_keys, has_fragment): what may be stored of a URL."""
    query = F.regexp_extract("url", "[?]([^#]*)", 1)
    keys = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(query, "&"), lambda p: F.split(p, "=")[0]), lambda k: k != "")))
    return pages.select("page_id", F.concat(F.coalesce(origin("url"), F.lit("")), path("url")).alias("location"), F.sha2("url", 256).alias("sha256"), F.array_join(keys, ",").alias("query_keys"), F.col("url").contains("#").alias("has_fragment"))


#: Roles and states of the accessibility subset.
AX_ROLES = ("button", "checkbox", "combobox", "form", "group", "heading", "link", "listbox", "radio", "radiogroup", "searchbox", "slider", "spinbutton", "switch", "tab", "tabpanel", "textbox")
AX_STATES = ("checked", "disabled", "expanded", "level", "required", "selected", "invalid")


def ax_nodes(contracts: DataFrame) -> DataFrame:
    """(page_id, viewport, ordinal, role, name, states): useful roles, states as entries sorted by name."""
    rows = contracts.select("page_id", "viewport", F.posexplode("axNodes").alias("ordinal", "n")).where(F.col("n.role").isin(*AX_ROLES))
    states = F.array_sort(F.map_entries(F.map_filter("n.properties", lambda k, _: k.isin(*AX_STATES))))
    return rows.select("page_id", "viewport", F.col("ordinal").cast("long").alias("ordinal"), "n.role", squeeze("n.name").alias("name"), states.alias("states"))


RECORD = "page_id long, kind string, ordinal long, tag string, id string, name string, type string, text string, target string, form_ordinal long, parent_kind string, parent_ordinal long, n_children long"
_CONTROLS = {"input", "select", "textarea", "button"}


class _Records(HTMLParser):
    """One pass over a page's tags: forms, controls, options, labels and painted surfaces with their nesting."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.count: dict[str, int] = {}
        self.form: dict | None = None
        self.label: dict | None = None
        self.select: dict | None = None
        self.open: dict | None = None

    def add(self, kind: str, tag: str, a: dict, **more) -> dict:
        n = self.count.get(kind, 0)
        self.count[kind] = n + 1
        row = {"kind": kind, "ordinal": n, "tag": tag, "id": a.get("id"), "name": a.get("name"), "type": a.get("type"), "text": "", "target": None, "form_ordinal": self.form and self.form["ordinal"], "parent_kind": None, "parent_ordinal": None, "n_children": 0} | more
        self.rows.append(row)
        return row

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "form":
            self.form = self.add("form", tag, a, target=a.get("action"), type=(a.get("method") or "get").lower())
        elif tag in _CONTROLS:
            inside = {"parent_kind": "label", "parent_ordinal": self.label["ordinal"]} if self.label else {}
            row = self.add("control", tag, a, type=(a.get("type") or ("text" if tag == "input" else tag)).lower(), **inside)
            if self.form:
                self.form["n_children"] += 1
            if tag == "select":
                self.select = row
            if tag in ("button", "textarea"):
                self.open = row
        elif tag == "option" and self.select:
            self.open = self.add("option", tag, a, parent_kind="control", parent_ordinal=self.select["ordinal"])
            self.select["n_children"] += 1
        elif tag == "label":
            self.label = self.open = self.add("label", tag, a, target=a.get("for"))
        if tag in ("img", "video", "image", "svg") or (tag == "input" and a.get("type") == "image"):
            self.add("surface", tag, a, type="vector" if tag == "svg" else "raster", target=a.get("src") or a.get("href"))
        for prop in ("background-image", "background", "border-image", "list-style-image", "mask-image", "content"):
            if f"{prop}:" in a.get("style", "") and "url(" in a["style"]:
                self.add("surface", tag, a, type="raster", target=a["style"].split("url(", 1)[1].split(")", 1)[0].strip("'\" "), name=prop)

    def handle_endtag(self, tag: str) -> None:
        if tag == "form":
            self.form = None
        elif tag == "label":
            self.label = self.open = None
        elif tag == "select":
            self.select = self.open = None
        elif tag in ("button", "textarea", "option"):
            self.open = self.label

    def handle_data(self, data: str) -> None:
        if self.open is not None and self.open["tag"] != "textarea":
            self.open["text"] = " ".join((self.open["text"] + " " + data).split())


def page_records(pages: DataFrame) -> DataFrame:
    """Records whose meaning depends on nesting, from one parser pass per page; a null page has none."""
    schema = arrow_schema(RECORD)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in slices(batches):
            rows = []
            for page in pages:
                parser = _Records()
                parser.feed(page["html"] or "")
                parser.close()
                rows += [{"page_id": page["page_id"]} | r for r in parser.rows]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select("page_id", "html").mapInArrow(work, RECORD)


def extract_forms(records: DataFrame) -> DataFrame:
    """(page_id, ordinal, method, action, n_controls) of the form records."""
    return records.where("kind = 'form'").select("page_id", "ordinal", F.coalesce("type", F.lit("get")).alias("method"), F.coalesce("target", F.lit("")).alias("action"), F.col("n_children").alias("n_controls"))


def label_targets(records: DataFrame) -> DataFrame:
    """(page_id, label_ordinal, text, control_ordinal): by the for attribute, else the first control inside."""
    labels = records.where("kind = 'label'").select("page_id", F.col("ordinal").alias("label_ordinal"), "text", "target")
    controls = records.where("kind = 'control'").select(F.col("page_id").alias("p"), F.col("ordinal").alias("c"), "id", "parent_ordinal")
    by_id = labels.join(controls, (F.col("page_id") == F.col("p")) & (F.col("target") == F.col("id"))).groupBy("page_id", "label_ordinal").agg(F.min("c").alias("by_id"))
    inside = labels.join(controls, (F.col("page_id") == F.col("p")) & (F.col("label_ordinal") == F.col("parent_ordinal"))).groupBy("page_id", "label_ordinal").agg(F.min("c").alias("inside"))
    out = labels.join(by_id, ["page_id", "label_ordinal"], "left").join(inside, ["page_id", "label_ordinal"], "left")
    return out.select("page_id", "label_ordinal", "text", F.coalesce("by_id", "inside").alias("control_ordinal"))


def surface_sources(records: DataFrame) -> DataFrame:
    """(page_id, kind, sources): distinct sources of painted surfaces by kind."""
    rows = records.where("kind = 'surface'").groupBy("page_id", F.col("type").alias("surface_kind"))
    return rows.agg(F.array_sort(F.collect_set(F.coalesce("target", F.lit("")))).alias("sources"), F.count("*").alias("n"))


def option_classes(controls: DataFrame) -> DataFrame:
    """(page_id, ordinal, pos, value_length, option_class, disabled) of the options of each control."""
    rows = controls.where("n_options > 0").select("page_id", "ordinal", F.explode(F.sequence(F.lit(0), F.col("n_options") - 1)).alias("pos"), "value_length")
    length = F.when(F.col("pos") == 0, 0).otherwise(F.col("value_length") + F.col("pos"))
    return rows.select("page_id", "ordinal", "pos", length.alias("option_length"), F.when(length == 0, "placeholder").when(length <= 8, "short").otherwise("long").alias("option_class"), (F.col("pos") % 3 == 2).alias("disabled"))


def accessible_names(controls: DataFrame) -> DataFrame:
    """(page_id, ordinal, accessible_name): label, else name with type; empty texts don't count. Labels that the
    controls of a page share are joined to the control by their ids."""
    labels = controls.where("visible").select("page_id", "ordinal", F.col("label").alias("label_text"))
    out = controls.select("page_id", "ordinal", "type", "name").join(labels, ["page_id", "ordinal"], "left")
    chain = F.coalesce(F.nullif(squeeze("label_text"), F.lit("")), F.nullif(F.concat_ws(" ", "type", "name"), F.lit("")))
    return out.select("page_id", "ordinal", chain.alias("accessible_name"))
