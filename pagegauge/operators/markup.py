"""Elements of stored HTML as a table, names by association, and sanitising by a rewriting token stream."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.expressions import squeeze
from ..sources.readers import arrow_schema, cut, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be left out: an opening tag of the set closes an open one.
CLOSES = {"option": {"option"}, "optgroup": {"option", "optgroup"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "label": {"label"}, "a": {"a"}, "button": {"button"}}
ELEMENT = "page_id long, node int, parent int, tag string, id string, attributes map<string,string>, text string, label int, fieldset int, labelled_group int, select int, form int"
SCOPES = ("label", "fieldset", "select", "form")
#: Elements whose text is kept; so is that of all with an id, which others may refer to.
TEXTED = frozenset("a button h1 h2 h3 h4 h5 h6 label legend option title".split())


class _Elements(HTMLParser):
    """One pass over a page: every element with its text and the nearest label, fieldset, group, select and form."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open and self.open[-1]["tag"] in CLOSES.get(tag, ()):
            self.open.pop()
        a: dict[str, str] = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        up = self.open[-1] if self.open else None
        row = {"node": len(self.rows), "parent": up and up["node"], "tag": tag, "id": a.get("id") or None, "attributes": a, "parts": [] if tag in TEXTED or a.get("id") else None}
        for scope in SCOPES:
            row[scope] = up and (up["node"] if up["tag"] == scope else up[scope])
        grouped = up and up["attributes"].get("role") in ("group", "radiogroup") and "aria-labelledby" in up["attributes"]
        row["labelled_group"] = up and (up["node"] if grouped else up["labelled_group"])
        self.rows.append(row)
        if tag not in VOID:
            self.open.append(row)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        for row in self.open:
            if row["parts"] is not None:
                row["parts"].append(data)


def page_elements(pages: DataFrame, tags: frozenset[str] | None = None) -> DataFrame:
    """(page_id, node, parent, tag, id, attributes, text, scopes) of every element in document order.

    ``text`` is the whole text, with white space normalised, of elements with an id and of ``TEXTED``, else null. With
    ``tags``, only elements of these are given, under the same numbers. Attributes are those written first; their quoting
    and order don't matter. A null page has no elements.
    """
    schema = arrow_schema(ELEMENT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in slices(batches):
            rows = []
            for page in pages:
                parser = _Elements()
                parser.feed(page["html"] or "")
                parser.close()
                for r in parser.rows:
                    if tags is None or r["tag"] in tags:
                        text = None if r["parts"] is None else " ".join("".join(r["parts"]).split())
                        rows.append({"page_id": page["page_id"]} | r | {"text": text, "attributes": list(r["attributes"].items())})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select("page_id", "html").mapInArrow(work, ELEMENT)


def _attribute(name: str) -> Column:
    return F.coalesce(squeeze(F.coalesce(F.col("attributes")[name], F.lit(""))), F.lit(""))


def referenced_texts(elements: DataFrame, attribute: str) -> DataFrame:
    """(page_id, node, texts): for the ids listed in an attribute, the texts of the elements that have them, in the
    order of the list. Of elements that share an id the first counts; ids that nobody has are left out."""
    ids = elements.where(F.col("attributes")[attribute].isNotNull())
    ids = ids.select("page_id", "node", F.posexplode(F.split(_attribute(attribute), " ")).alias("place", "id")).where("id <> ''")
    first = elements.where("id is not null").groupBy("page_id", "id").agg(F.min_by("text", "node").alias("text"))
    found = ids.join(first.hint("shuffle_hash"), ["page_id", "id"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return found.groupBy("page_id", "node").agg(texts.alias("texts"))


def label_texts(elements: DataFrame) -> DataFrame:
    """(page_id, node, label_text): texts of a control's labels in document order, by their ``for`` (the first element
    of that id) or, without one, around it (the first control inside)."""
    controls = elements.where("tag in ('input', 'select', 'textarea', 'button')")
    first = elements.where("id is not null").groupBy("page_id", "id").agg(F.min("node").alias("node"))
    labels = elements.where("tag = 'label'").select("page_id", F.col("node").alias("label"), "text", F.col("attributes")["for"].alias("for"))
    named = labels.where("for is not null").join(first.withColumnRenamed("id", "for").hint("shuffle_hash"), ["page_id", "for"]).select("page_id", "node", "label", "text")
    inside = controls.where("label is not null").groupBy("page_id", "label").agg(F.min("node").alias("node"))
    around = labels.where("for is null").join(inside.hint("shuffle_hash"), ["page_id", "label"]).select("page_id", "node", "label", "text")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("label", "text"))), lambda x: x["text"])
    return named.unionByName(around).groupBy("page_id", "node").agg(squeeze(F.array_join(texts, " ")).alias("label_text"))


#: Attributes that name a control or lead to its name.
NAMING = "aria-label aria-labelledby for type value placeholder title alt".split()


def control_names(elements: DataFrame) -> DataFrame:
    """(page_id, node, tag, type, accessible_name, question) of every control.

    The name is the first that isn't empty of: aria-label, the texts of aria-labelledby, the labels' texts; for a
    button its text, for an input of type button or submit its value, for others placeholder, title or alt. The
    question is the text of the first known id that the nearest labelled group names, else of the nearest fieldset's
    own legend. All references are joins by page; no step holds more than a page's elements of one key. Seven joins read
    the elements, so what they need of them is parsed and written once.
    """
    used = F.col("tag").isin("input", "select", "textarea", "button", "label", "legend") | F.col("id").isNotNull() | F.map_contains_key("attributes", "aria-labelledby")
    naming = F.map_filter("attributes", lambda k, _: k.isin(*NAMING)).alias("attributes")
    elements = cut(elements.where(used).select("page_id", "node", "parent", "tag", "id", naming, "text", "label", "fieldset", "labelled_group"), "elements")
    controls = elements.where("tag in ('input', 'select', 'textarea', 'button')")
    by_id = referenced_texts(elements, "aria-labelledby").select("page_id", "node", F.col("texts").alias("named"))
    groups = by_id.select("page_id", F.col("node").alias("labelled_group"), F.get("named", F.lit(0)).alias("group_text"))
    legends = elements.where("tag = 'legend' and parent = fieldset").groupBy("page_id", "fieldset").agg(F.min_by("text", "node").alias("legend"))
    rows = controls.join(by_id.hint("shuffle_hash"), ["page_id", "node"], "left").join(label_texts(elements).hint("shuffle_hash"), ["page_id", "node"], "left")
    rows = rows.join(groups.hint("shuffle_hash"), ["page_id", "labelled_group"], "left").join(legends.hint("shuffle_hash"), ["page_id", "fieldset"], "left")
    kind = F.when(F.col("tag").isin("input", "button"), F.coalesce(F.nullif(F.lower(_attribute("type")), F.lit("")), F.when(F.col("tag") == "input", "text").otherwise("submit"))).otherwise(F.col("tag"))
    some = lambda c: F.nullif(c, F.lit(""))
    hints = F.coalesce(some(_attribute("placeholder")), some(_attribute("title")), some(_attribute("alt")))
    own = F.when(F.col("tag") == "button", F.col("text")).when((F.col("tag") == "input") & kind.isin("button", "submit"), _attribute("value")).otherwise(hints)
    name = F.coalesce(some(_attribute("aria-label")), some(squeeze(F.array_join("named", " "))), some("label_text"), own, F.lit(""))
    return rows.select("page_id", "node", "tag", kind.alias("type"), name.alias("accessible_name"), F.coalesce("group_text", "legend", F.lit("")).alias("question"))


#: Fixed values of the option classes.
COMMON = r"(?i)^(?:yes|no|true|false|on|off|none|null|0|1)$"


def control_options(elements: DataFrame) -> DataFrame:
    """(page_id, control, place, text, value_length, option_class, disabled) of the options of every select.

    An option without a value attribute has its text as value. The class is empty, same-as-visible-text, common-enum or
    opaque; values themselves aren't kept.
    """
    rows = elements.where("tag = 'option' and select is not null")
    value = F.coalesce(F.col("attributes")["value"], F.col("text"))
    place = F.row_number().over(W.partitionBy("page_id", "select").orderBy("node")) - 1
    kind = F.when(value == "", "empty").when(F.lower(squeeze(value)) == F.lower("text"), "same-as-visible-text").when(value.rlike(COMMON), "common-enum").otherwise("opaque")
    disabled = F.map_contains_key("attributes", "disabled")
    return rows.select("page_id", F.col("select").alias("control"), place.cast("int").alias("place"), "text", F.length(value).alias("value_length"), kind.alias("option_class"), disabled.alias("disabled"))


# -- sanitising ---------------------------------------------------------------------------------------------------

#: What a sanitised page may not hold, and what takes its place.
REMOVED = frozenset("script iframe object embed base".split())
REMOVED_LINKS = frozenset("preload prefetch modulepreload preconnect dns-prefetch manifest".split())
DROPPED_ATTRIBUTES = frozenset("nonce integrity ping srcdoc".split())
SENSITIVE = re.compile("captcha|csrf|token|secret|authorization|signature|sitekey", re.I)
SYNTHETIC, ENDPOINT, MISSING = "synthetic-local-value", "/api/applications", "/unavailable"
ADDRESSES = ("src", "href", "poster", "background", "action", "data", "cite", "longdesc", "xlink:href")
PRESENTATION = ("style", "clip-path", "cursor", "fill", "filter", "marker-end", "marker-mid", "marker-start", "mask", "stroke")
CREDENTIALS = re.compile(r"(?:password|passwd|secret|api_?key|token|csrf|authorization)[\"']?\s*[:=]|bearer\s+\S{8,}|eyJ[\w-]{8,}\.", re.I)
ENUM = re.compile(COMMON[4:], re.I)
COUNTERS = ("elements", "attributes", "comments", "links", "forms", "hidden_values", "freeform_values", "choice_values", "option_values", "editable_values", "sensitive_attributes", "sensitive_metadata", "addresses")
APPROVAL = "struct<viewport:string,category:string,kind:string,key:string,fields:array<string>>"


def _inert_css(css: str) -> str:
    """CSS without addresses: imports go, url() and quoted image-set entries become ``none``; escapes and comments are
    resolved first, as they may hide both."""
    css = re.sub(r"/\*.*?(?:\*/|$)", " ", css, flags=re.S)
    css = re.sub(r"\\([0-9a-fA-F]{1,6})\s?|\\(.)", lambda m: m[2] or chr(min(int(m[1], 16), 0x10FFFF)), css)
    css = re.sub(r"@import\b[^;]*(?:;|$)", "", css, flags=re.I)
    css = re.sub(r"(?:url|expression)\s*\((?:[^()\"']|\"[^\"]*\"|'[^']*')*(?:\)|$)", "none", css, flags=re.I)
    return re.sub(r"image-set\s*\([^)]*(?:\)|$)|-moz-binding|behavior\s*:", "none", css, flags=re.I)


class _Sanitiser(HTMLParser):
    """Tokens in, tokens out: what is active, outgoing or personal is dropped or replaced as it streams by."""

    def __init__(self, assets: dict[str, str]) -> None:
        super().__init__(convert_charrefs=False)
        self.assets = assets
        self.out: list[str] = []
        self.n = dict.fromkeys(COUNTERS, 0)
        self.approvals: list[dict] = []
        self.skipped: list[str] = []  # open elements that go with all they hold
        self.style = False
        self.count = {"controls": 0, "forms": 0}
        self.option: dict | None = None
        self.select: dict | None = None

    def approve(self, category: str, key: str, fields: list[str]) -> None:
        self.approvals.append({"viewport": "*", "category": category, "kind": "changed", "key": key, "fields": fields})

    def address(self, value: str) -> str:
        if value.strip().startswith("#"):
            return value
        if value.strip() in self.assets:
            return self.assets[value.strip()]
        self.n["addresses"] += 1
        return MISSING

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a: dict[str, str | None] = {}
        for k, v in attrs:
            a.setdefault(k, v)
        if self.skipped:
            if tag == self.skipped[-1] and tag not in VOID:
                self.skipped.append(tag)
            return
        if tag in ("option", "optgroup"):
            self.close_option()
        rel = set((a.get("rel") or "").lower().split())
        equiv = (a.get("http-equiv") or "").strip().lower()
        if tag in REMOVED or tag == "link" and rel & REMOVED_LINKS or tag == "meta" and equiv in ("refresh", "content-security-policy"):
            self.n["elements"] += 1
            if tag not in VOID:
                self.skipped.append(tag)
            return
        self.style = tag == "style"
        a = self.safe(tag, a)
        key = f"{tag}:{a.get('name') or a.get('id') or ''}#{self.count['controls']}"
        emptied = False
        if tag in ("input", "select", "textarea", "button"):
            self.count["controls"] += 1
            emptied = self.control(tag, a, key)
        elif tag == "form":
            self.n["forms"] += 1
            fields = ["actionAttribute", "action"] + (["methodAttribute", "method"] if (a.get("method") or "get").lower() != "post" else [])
            self.approve("forms", f"form:#{self.count['forms']}", fields)
            self.count["forms"] += 1
            a |= {"action": ENDPOINT, "method": "post"}
            a.pop("target", None)
        elif tag == "meta" and a.get("content") and (SENSITIVE.search(" ".join(a.get(k) or "" for k in ("name", "http-equiv", "property", "itemprop"))) or CREDENTIALS.search(a["content"])):
            a["content"] = SYNTHETIC
            self.n["sensitive_metadata"] += 1
        elif tag == "option":
            self.option = {"attributes": a, "at": len(self.out), "text": []}
        if a.get("contenteditable") is not None and a["contenteditable"].lower() != "false" or "contenteditable" in a and a["contenteditable"] is None:
            emptied = True
            self.n["editable_values"] += 1
        if tag == "select":
            self.select = {"key": key, "changed": False}
        self.out.append(self.written(tag, a))
        if emptied and tag not in VOID:
            self.skipped.append(tag)
            self.out.append(f"</{tag}>")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    @staticmethod
    def written(tag: str, a: dict[str, str | None]) -> str:
        return f"<{tag}" + "".join(f" {k}" if v is None else f' {k}="{escape(v)}"' for k, v in a.items()) + ">"

    def safe(self, tag: str, a: dict[str, str | None]) -> dict[str, str | None]:
        out: dict[str, str | None] = {}
        link = tag in ("a", "area") and ("href" in a or "xlink:href" in a)
        for k, v in a.items():
            if k.startswith("on") or k in DROPPED_ATTRIBUTES or not re.fullmatch(r"[\w:.@-]+", k):
                self.n["attributes"] += 1
            elif link and k in ("href", "xlink:href"):
                continue
            elif SENSITIVE.search(k) and v or k.startswith("data-") and v and CREDENTIALS.search(v):
                out[k] = SYNTHETIC
                self.n["sensitive_attributes"] += 1
            elif k in ADDRESSES and v:
                if re.match(r"[\x00-\x20]*(?:j\s*a\s*v\s*a|vb)\s*script\s*:", v, re.I):
                    self.n["attributes"] += 1
                else:
                    out[k] = self.address(v)
            elif k in ("srcset", "imagesrcset") and v:
                parts = [e.split(None, 1) for e in v.split(",") if e.strip()]
                out[k] = ", ".join(" ".join([self.address(p[0]), *p[1:]]) for p in parts)
            elif k in PRESENTATION and v:
                out[k] = _inert_css(v)
            elif k == "formaction":
                out[k] = ENDPOINT
            elif k == "formmethod":
                out[k] = "post"
            elif k != "formtarget":
                out[k] = v
        if link:
            self.n["links"] += 1
            out["data-replica-source-link"] = ""
            out.setdefault("role", "link")
            out.setdefault("tabindex", "0")
        return out

    def control(self, tag: str, a: dict, key: str) -> bool:
        """Values of a control; true if what it holds goes."""
        kind = (a.get("type") or ("text" if tag == "input" else tag)).strip().lower()
        value = a.get("value") or ""
        if kind == "hidden":
            if value:
                self.n["hidden_values"] += 1
                if len(value) != len(SYNTHETIC):
                    self.approve("controls", key, ["hiddenValueLength"])
                a["value"] = SYNTHETIC
        elif tag == "textarea" or tag == "input" and kind not in ("button", "submit", "reset", "image", "checkbox", "radio"):
            if value:
                self.approve("controls", key, ["valuePresent", "valueLength", "valueClassification", "valueFingerprint"])
            if value or tag == "textarea":
                self.n["freeform_values"] += bool(value)
                a["value"] = ""
            return tag == "textarea"
        elif kind in ("checkbox", "radio") and value and not ENUM.search(value) and value.strip().lower() != " ".join((a.get("aria-label") or "").lower().split()):
            self.n["choice_values"] += 1
            a["value"] = f"synthetic-local-choice-{self.n['choice_values']:04d}"
        return False

    def close_option(self) -> None:
        if self.option is None:
            return
        a, value = self.option["attributes"], self.option["attributes"].get("value")
        text = " ".join("".join(self.option["text"]).split())
        if value and " ".join(value.split()).lower() != text.lower() and not ENUM.search(value):
            self.n["option_values"] += 1
            a["value"] = f"synthetic-local-option-{self.n['option_values']:04d}"
            self.out[self.option["at"]] = self.written("option", a)
            if self.select and not self.select["changed"]:
                self.select["changed"] = True
                self.approve("controls", self.select["key"], ["optionsHash", "options"])
        self.option = None

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag == self.skipped[-1]:
                self.skipped.pop()
            return
        if tag in ("option", "select", "optgroup"):
            self.close_option()
        if tag == "select":
            self.select = None
        self.style = False
        if tag not in VOID and tag not in REMOVED:
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if self.skipped:
            return
        if self.option is not None:
            self.option["text"].append(data)
        # text can't hold a tag here: what looks like the begin of one is written as text
        self.out.append(_inert_css(data).replace("<", "") if self.style else data.replace("<", "&lt;"))

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")

    def handle_comment(self, data: str) -> None:
        self.n["comments"] += 1

    def handle_decl(self, decl: str) -> None:
        if not self.skipped and decl.lower().startswith("doctype"):
            self.out.append("<!DOCTYPE html>")

    def unknown_decl(self, data: str) -> None:
        self.n["comments"] += 1

    def handle_pi(self, data: str) -> None:
        self.n["comments"] += 1


def sanitize_html(pages: DataFrame) -> DataFrame:
    """(page_id, html, counters, approvals): pages with nothing active, outgoing or personal in them.

    Scripts, frames, objects, base, preloads, refreshes, policies and comments go, and handlers and nonces of all other
    elements; links become inert; forms post to one local endpoint; hidden, free-form, choice, option, editable and
    sensitive values are replaced. Addresses are those that an optional column ``assets map<string,string>`` gives, or
    ``MISSING``; fragments stay. Tokens are written anew with one quoting, so what is dropped doesn't depend on how it
    was written. ``approvals`` are the differences that follow from this, as rows for ``apply_approvals``. A null page
    is an empty one; text after an end that never comes is dropped with its element.
    """

    text = pa.string()
    approval = pa.struct([("viewport", text), ("category", text), ("kind", text), ("key", text), ("fields", pa.list_(text))])
    schema = arrow_schema("page_id long, html string, counts array<long>", approvals=pa.list_(approval))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in slices(batches):
            rows = []
            for page in pages:
                parser = _Sanitiser(dict(page["assets"] or ()))
                parser.feed(page["html"] or "")
                parser.close()
                parser.close_option()
                rows.append({"page_id": page["page_id"], "html": "".join(parser.out), "counts": list(parser.n.values()), "approvals": parser.approvals})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    assets = F.col("assets") if "assets" in pages.columns else F.lit(None).cast("map<string,string>").alias("assets")
    out = pages.select("page_id", "html", assets).mapInArrow(work, f"page_id long, html string, counts array<long>, approvals array<{APPROVAL}>")
    counters = F.struct(*[F.get("counts", F.lit(i)).alias(n) for i, n in enumerate(COUNTERS)])
    return out.select("page_id", "html", counters.alias("counters"), "approvals")
