"""XML documents of attributes (NativeDicomModel) to the rows of `tagged_json` and back, items of sequences at any depth.

An attribute has tag and vr, and Value, PersonName, Item, BulkData or InlineBinary children, the first three numbered from 1.
Each document is parsed by itself, in Arrow batches; keywords and private creators aren't kept. A null document, one that
is no such XML, and one with a document type (which may hide entities) have no elements; `faults` tells them.
"""

from __future__ import annotations

import json
import re
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tagged_json

#: Names of the groups and components of a person's name, in order (fixed values).
GROUPS = ("Alphabetic", "Ideographic", "Phonetic")
PARTS = ("FamilyName", "GivenName", "MiddleName", "NamePrefix", "NameSuffix")
ROOT = "NativeDicomModel"
READ = T.StructType([T.StructField("json", T.StringType()), T.StructField("fault", T.StringType())])


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _numbered(children: list[ElementTree.Element], read) -> list:
    """What the children hold, by their number; places without one are null."""
    held = {}
    for c in children:
        number = int(c.get("number", ""))
        if number < 1 or number in held or number > 1_000_000:
            raise ValueError("number")
        held[number] = read(c)
    return [held.get(k) for k in range(1, max(held, default=0) + 1)]


def _name(element: ElementTree.Element) -> dict:
    groups = {_local(g): {_local(p): p.text or "" for p in g} for g in element}
    if set(groups) - set(GROUPS) or any(set(g) - set(PARTS) for g in groups.values()):
        raise ValueError("name")
    return {g: "^".join(groups[g].get(p, "") for p in PARTS).rstrip("^") for g in GROUPS if g in groups}


def _value(text: str | None, vr: str) -> object:
    if vr in tagged_json.NUMBERS and re.fullmatch(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?", (text or "").strip()):
        return json.loads(text.strip())
    return text or ""


def _attributes(parent: ElementTree.Element) -> dict:
    out = {}
    for a in parent:
        tag, vr = a.get("tag", ""), a.get("vr", "")
        if _local(a) != "DicomAttribute" or not re.fullmatch(r"[0-9A-Fa-f]{8}", tag) or not re.fullmatch(r"[A-Z]{2}", vr) or tag.upper() in out:
            raise ValueError("attribute")
        of: dict[str, list] = {}
        for c in a:
            of.setdefault(_local(c), []).append(c)
        if len(of) > 1 or set(of) - {"Value", "PersonName", "Item", "BulkData", "InlineBinary"}:
            raise ValueError("attribute")
        one: dict = {"vr": vr}
        for kind, children in of.items():
            if kind == "BulkData":
                one["BulkDataURI"] = children[0].get("uri") or children[0].get("uuid", "")
            elif kind == "InlineBinary":
                one["InlineBinary"] = (children[0].text or "").strip()
            else:
                one["Value"] = _numbered(children, {"Value": lambda c: _value(c.text, vr), "PersonName": _name, "Item": _attributes}[kind])  # noqa: B023
        out[tag.upper()] = one
    return out


def to_json(xml: str) -> tuple[str | None, str | None]:
    """(tagged JSON, fault) of an XML document."""
    if re.search(r"<!DOCTYPE", xml, re.IGNORECASE):
        return None, "document type"
    try:
        root = ElementTree.fromstring(xml)
        if _local(root) != ROOT:
            return None, "root"
        return json.dumps(_attributes(root), ensure_ascii=False), None
    except ElementTree.ParseError:
        return None, "xml"
    except (ValueError, RecursionError) as e:
        return None, str(e) if str(e) in ("attribute", "name") else "number"


def _written(document: dict) -> str:
    out = []
    for tag, a in document.items():
        vr, body = a["vr"], ""
        if "BulkDataURI" in a:
            body = f"<BulkData uri={quoteattr(a['BulkDataURI'])}/>"
        elif "InlineBinary" in a:
            body = f"<InlineBinary>{a['InlineBinary']}</InlineBinary>"
        for k, v in enumerate(a.get("Value") or [], 1):
            if v is None:
                continue
            if vr == "SQ":
                body += f'<Item number="{k}">{_written(v)}</Item>'
            elif vr == "PN":
                groups = "".join(f"<{g}>" + "".join(f"<{p}>{escape(t)}</{p}>" for p, t in zip(PARTS, v[g].split("^"), strict=False) if t) + f"</{g}>" for g in GROUPS if g in v)
                body += f'<PersonName number="{k}">{groups}</PersonName>'
            else:
                body += f'<Value number="{k}">{escape(v if isinstance(v, str) else json.dumps(v))}</Value>'
        out.append(f'<DicomAttribute tag="{tag}" vr="{vr}">{body}</DicomAttribute>' if body else f'<DicomAttribute tag="{tag}" vr="{vr}"/>')
    return "".join(out)


def to_xml(text: str) -> str:
    """The XML document of a tagged JSON document."""
    return f'<?xml version="1.0" encoding="UTF-8"?><{ROOT}>{_written(json.loads(text))}</{ROOT}>'


@F.pandas_udf(READ)
def _read(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if x is None else to_json(x) for x in xml], columns=["json", "fault"]).astype(object)


@F.pandas_udf(T.StringType())
def _xml(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else to_xml(t) for t in text], dtype=object)


def elements(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, tag, vr, values, uri, binary) of each document's attributes, as `tagged_json.elements` gives them."""
    return tagged_json.elements(docs.select(key, _read(xml)["json"].alias("json")), key, "json")


def faults(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, fault) of the documents that aren't read: document type, xml, root, attribute, name, number."""
    return docs.select(key, _read(xml)["fault"].alias("fault")).where("fault IS NOT NULL")


def documents(rows: DataFrame, key: str) -> DataFrame:
    """(key, xml) of rows of elements."""
    return tagged_json.documents(rows, key).select(key, _xml("json").alias("xml"))
