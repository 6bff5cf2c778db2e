"""Metadata inside PDF bytes: XMP packets and the document information dictionary, read and written as columns.

A packet stands uncompressed in a file's bytes, so it is found by its marks and read by Spark's own XML parser; nothing runs in Python. A file that was
changed by appending holds several packets: the last one counts. The fields of tax and accounting are kept as Acrobat keeps
custom properties: in the information dictionary, and in the packet under the `pdfx` namespace. A dictionary in a compressed object
stream isn't seen here; `pdf.information` with a reader does that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators.metadata import FIELDS

#: The custom fields and their names in the information dictionary.
CUSTOM = {
    "korrespondent": "Korrespondent", "buchungsdatum": "Buchungsdatum", "steuerjahr": "Steuerjahr", "betrag": "Betrag",
    "waehrung": "Waehrung", "mwst_satz": "MwStSatz", "steuerlich_absetzbar": "SteuerlichAbsetzbar",
}
#: The namespaces of a packet.
NAMESPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "dc": "http://purl.org/dc/elements/1.1/", "pdf": "http://ns.adobe.com/pdf/1.3/", "pdfx": "http://ns.adobe.com/pdfx/1.3/",
}
#: Where a packet holds each field.
PLACES = {"title": "dc:title", "subject": "dc:subject", "description": "dc:description", "keywords": "pdf:Keywords"} | {f: f"pdfx:{n}" for f, n in CUSTOM.items()}

_PACKET = r"(?s)<x:xmpmeta.*?</x:xmpmeta>"
#: Characters that XML can't hold.
_NO_XML = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFE}\x{FFFF}]"
_ITEMS = "struct<`rdf:li`: array<struct<_VALUE: string, `_xml:lang`: string>>>"
_VALUE = f"struct<_VALUE: string, `rdf:Alt`: {_ITEMS}, `rdf:Bag`: {_ITEMS}, `rdf:Seq`: {_ITEMS}>"
_SCHEMA = (
    "`rdf:RDF` struct<`rdf:Description`: array<struct<" + ", ".join([f"`{p}`: {_VALUE}" for p in PLACES.values()] + [f"`_{p}`: string" for p in PLACES.values()]) + ">>>, _corrupt_record string"
)


def _set(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def packet_of(content: Column) -> Column:
    """The last XMP packet of a file's bytes; null where there is none or it isn't UTF-8."""
    found = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(_PACKET), F.lit(0))
    return F.try_validate_utf8(F.encode(F.try_element_at(found, F.lit(-1)), "ISO-8859-1").cast("string"))


def _values(parsed: Column) -> Column:
    """field, value of all descriptions in their order: what stands as an attribute, as text or as items (the default language first, the words of a bag joined)."""

    def items(held: Column) -> Column:
        return F.filter(F.coalesce(held["rdf:li"], F.array().cast("array<struct<_VALUE: string, `_xml:lang`: string>>")), lambda i: _set(i["_VALUE"]).isNotNull())

    def value(at: Column) -> Column:
        alt, listed = items(at["v"]["rdf:Alt"]), F.concat(items(at["v"]["rdf:Bag"]), items(at["v"]["rdf:Seq"]))
        default = F.try_element_at(F.filter(alt, lambda i: i["_xml:lang"] == "x-default"), F.lit(1))["_VALUE"]
        joined = F.when(F.size(listed) > 0, F.array_join(F.transform(listed, lambda i: i["_VALUE"]), ", "))
        return F.coalesce(_set(at["a"]), _set(at["v"]["_VALUE"]), default, F.try_element_at(alt, F.lit(1))["_VALUE"], joined)

    held = F.transform(parsed["rdf:RDF"]["rdf:Description"], lambda d: F.array(*[F.struct(F.lit(f).alias("field"), d[p].alias("v"), d[f"_{p}"].alias("a")) for f, p in PLACES.items()]))
    return F.filter(F.transform(F.flatten(held), lambda at: F.struct(at["field"].alias("field"), value(at).alias("value"))), lambda x: x["value"].isNotNull())


def _pdf_string(raw: Column) -> Column:
    """A string of the dictionary: <hex> in UTF-16 with its mark or Latin-1, or (text) with backslashes; null where it isn't whole."""
    digits = F.regexp_replace(F.regexp_replace(raw, r"[<>\s]", ""), "(?i)^FEFF", "")
    wide = raw.rlike(r"(?i)^<\s*FEFF")
    latin = F.when(~wide & (F.length(digits) % 2 == 0), F.decode(F.unhex(digits), "ISO-8859-1"))
    pairs = F.when(wide & digits.rlike(r"(?i)\A([0-9A-CE-F]...|D[0-7]..|D[89AB]..D[C-F]..)*\z"), F.decode(F.unhex(digits), "UTF-16BE"))
    plain = F.regexp_replace(F.regexp_replace(F.substring(raw, 2, 1 << 20), r"\)\z", ""), r"\\([()\\])", "$1")
    return F.when(raw.startswith("<"), F.coalesce(pairs, latin)).otherwise(plain)


def _info(content: Column) -> Column:
    """field, value of all entries of dictionaries in the order of the bytes."""
    entry = rf"(?s)/({'|'.join(CUSTOM.values())})\s*(<[0-9A-Fa-f\s]*>|\((?:\\.|[^\\()]|\([^()]*\))*+\))"
    names = F.create_map(*[F.lit(x) for f, n in CUSTOM.items() for x in (n, f)])
    found = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(entry), F.lit(0))
    read = F.transform(found, lambda m: F.struct(names[F.regexp_extract(m, r"^/(\w+)", 1)].alias("field"), _set(_pdf_string(F.regexp_replace(m, r"^/\w+\s*", ""))).alias("value")))
    return F.filter(read, lambda x: x["value"].isNotNull())


def read(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path and the FIELDS of files(path, content): from the last packet, a custom field from the last dictionary that has it before the packet.

    A file without a packet, and one whose packet is cut or no XML, has nulls for what stands in packets.
    """
    raw = files.select(F.col(path_col).alias("path"), packet_of(F.col(content_col)).alias("packet"), _info(F.col(content_col)).alias("info"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "attributePrefix": "_", "valueTag": "_VALUE"}
    parsed = raw.withColumn("x", F.from_xml("packet", _SCHEMA, options))
    whole = F.when(F.col("x._corrupt_record").isNull(), F.col("x"))
    told = parsed.select("path", F.reverse("info").alias("info"), _values(whole).alias("held"))
    first = lambda c, f: F.try_element_at(F.filter(c, lambda x: x["field"] == f), F.lit(1))["value"]
    return told.select("path", *[(F.coalesce(first("info", f), first("held", f)) if f in CUSTOM else first("held", f)).alias(f) for f in FIELDS])


def _escaped(value: Column) -> Column:
    out = F.regexp_replace(value, _NO_XML, "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.replace(out, F.lit("\r"), F.lit("&#13;"))


def packet(**fields: Column) -> Column:
    """An XMP packet with the fields that have a value; null where none has."""
    unknown = fields.keys() - set(FIELDS)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    parts = []
    for field in [f for f in FIELDS if f in fields]:
        place, text = PLACES[field], _escaped(_set(fields[field].cast("string")))
        opened, closed = ('<rdf:Alt><rdf:li xml:lang="x-default">', "</rdf:li></rdf:Alt>") if field in ("title", "description") else ("", "")
        parts.append(F.concat(F.lit(f"<{place}>{opened}"), text, F.lit(f"{closed}</{place}>")))
    spaces = " ".join(f'xmlns:{k}="{v}"' for k, v in NAMESPACES.items() if k != "rdf")
    head = f'<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{NAMESPACES["rdf"]}"><rdf:Description rdf:about="" {spaces}>'
    return F.when(F.coalesce(*parts).isNotNull(), F.concat(F.lit(head), F.concat_ws("", *parts), F.lit('</rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>')))


def dictionary(**fields: Column) -> Column:
    """An information dictionary with the custom fields that have a value, in UTF-16; null where none has."""
    pairs = [F.concat(F.lit(f"/{n} <FEFF"), F.hex(F.encode(_set(fields[f].cast("string")), "UTF-16BE")), F.lit(">")) for f, n in CUSTOM.items() if f in fields]
    return F.when(F.coalesce(*pairs).isNotNull(), F.concat(F.lit("<< "), F.concat_ws(" ", *pairs), F.lit(" >>"))) if pairs else F.lit(None).cast("string")
