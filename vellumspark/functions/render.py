"""Inert HTML pages of a catalogue: no scripts, local links only, everything escaped."""

from html import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POLICY = "default-src 'none'; style-src 'self'; img-src 'self'"
FACETS_SHOWN, VALUES_SHOWN, NOTES_SHOWN = 2, 3, 8


def local_href(route: str) -> str:
    """A relative link, escaped; anything else is refused."""
    path = route.split("#", 1)[0]
    if not path or path.startswith("/") or ":" in path.split("/")[0] or "\\" in route or any(ord(c) < 32 for c in route):
        raise ValueError(f"no local link: {route!r}")
    return escape(route, quote=True)


def page(title: str, body: str, stylesheet: str = "catalogue.css") -> str:
    head = f'<meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{POLICY}"><title>{escape(title)}</title><link rel="stylesheet" href="{local_href(stylesheet)}">'
    return f"<!doctype html>\n<html><head>{head}</head><body>{body}</body></html>\n"


def facts(rows: list[tuple[str, str]]) -> str:
    return "<dl>" + "".join(f"<dt>{escape(k)}</dt><dd>{escape(v)}</dd>" for k, v in rows) + "</dl>" if rows else ""


def shown_values(values: list[str]) -> str:
    """The first three values, then how many more there are."""
    more = f"; and {len(values) - VALUES_SHOWN} more" if len(values) > VALUES_SHOWN else ""
    return "; ".join(values[:VALUES_SHOWN]) + more


def item_facets(facets: list[dict]) -> str:
    return facts([(f["label"], shown_values(f["values"])) for f in facets[:FACETS_SHOWN]])


def facet_notes(items: list[dict]) -> str:
    """The first note of each facet over all items, eight at most, then how many are left out."""
    notes = {}
    for item in items:
        for f in item.get("facets", []):
            if f.get("note"):
                notes.setdefault(f["key"], (f["label"], f["note"]))
    rows = list(notes.values())
    left = [("Additional facet notes", f"{len(rows) - NOTES_SHOWN} omitted")] if len(rows) > NOTES_SHOWN else []
    return facts(rows[:NOTES_SHOWN] + left)


def catalogue_page(title: str, collections: list[dict]) -> str:
    """A section for each collection: its items, or why it is not there."""
    out = []
    for c in collections:
        if "reader" not in c:
            out.append(f"<section><h2>{escape(c['label'])}</h2><p>{escape(c.get('reason', 'unavailable'))}</p></section>")
            continue
        items = "".join(f'<li><a href="{local_href(i["route"])}">{escape(i["label"])}</a>{item_facets(i.get("facets", []))} {escape(" ".join(r["kind"] + "/" + r["language"] for r in i.get("representations", [])))}</li>' for i in c["items"])
        out.append(f'<section><h2><a href="{local_href(c["reader"])}">{escape(c["label"])}</a></h2><p>{escape(c["status"])}</p>{facet_notes(c["items"])}<ol>{items}</ol></section>')
    return page(title, "".join(out))


# TEI elements and the HTML that shows them.
TEI_BLOCKS = {"ab": "p", "castList": "ul", "div": "div", "head": "h3", "item": "li", "l": "p", "lg": "div", "list": "ul", "note": "aside", "p": "p", "quote": "blockquote", "row": "tr", "sp": "div", "speaker": "p", "stage": "p", "table": "table"}
TEI_INLINE = {"add": "ins", "cell": "td", "corr": "span", "del": "del", "emph": "em", "foreign": "i", "gap": "span", "hi": "em", "name": "span", "orig": "span", "pb": "span", "q": "q", "ref": "span", "seg": "span", "sic": "span", "supplied": "span", "title": "cite", "unclear": "span"}
REND = {"bold": "strong", "italic": "em", "sub": "sub", "sup": "sup", "underline": "u"}


def tei_html(element) -> str:
    """Mixed content of a TEI element as HTML; unknown elements keep their text, anchors their ids."""
    tag = element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""
    inner = escape(element.text or "") + "".join(tei_html(c) + escape(c.tail or "") for c in element)
    if not tag:
        return ""
    if tag == "lb":
        return "<br>"
    if tag == "gap":
        inner = inner or "[…]"
    if tag == "pb":
        inner = f"[{escape(element.get('n') or '')}]"
    name = TEI_BLOCKS.get(tag) or next((REND[r] for r in (element.get("rend") or "").split() if r in REND), None) or TEI_INLINE.get(tag)
    ident = element.get("{http://www.w3.org/XML/1998/namespace}id")
    label = f' id="{escape(ident, quote=True)}"' if ident else ""
    return f"<{name}{label}>{inner}</{name}>" if name else inner


def tei_segments(root, route: str) -> list[tuple[str, str, str]]:
    """(kind, label, route with fragment) of numbered divisions and verses, repeats told apart."""
    seen, out = {}, []
    for e in root.iter():
        tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
        label = e.get("n")
        if tag in ("div", "lg", "l", "p", "ab") and label:
            n = seen[tag, label] = seen.get((tag, label), 0) + 1
            out.append((tag, label, f"{route}#{tag}-{escape(label)}" + (f"-{n}" if n > 1 else "")))
    return out


def rendered(documents: Column) -> Column:
    """TEI documents as HTML of their text, null where they are not well formed."""
    import xml.etree.ElementTree as E

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        def one(d):
            try:
                root = E.fromstring(d)
            except (E.ParseError, TypeError):
                return None
            body = next((e for e in root.iter() if isinstance(e.tag, str) and e.tag.endswith("}text")), None)
            return None if body is None else tei_html(body)

        return pd.Series([one(d) for d in docs], dtype=object)

    return run(documents)
