"""XMP packets and information dictionaries in file bytes: round trips, other writers' forms and damaged files."""

import pytest
from pyspark.sql import functions as F

from quillmill.operators.metadata import FIELDS
from quillmill.sources import xmp

VALUES = {
    "title": "Rechnung <Müller> & Söhne", "subject": "rechnung", "description": "Zeile 1\nZeile € 2 \U0001f600", "keywords": "rechnung, strom",
    "korrespondent": "Stadtwerke (Nord) \\ \"Süd\"", "buchungsdatum": "2024-05-06", "steuerjahr": "2024", "betrag": "142.50", "waehrung": "EUR", "mwst_satz": "19", "steuerlich_absetzbar": "ja",
}


def read(spark, *contents):
    rows = spark.createDataFrame([(str(i), None if c is None else bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")
    return [r.asDict() for r in xmp.read(rows).orderBy(F.col("path").cast("int")).collect()]


def made(spark, make, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(make(**{k: F.col(k) for k in values})).first()[0]


def rdf(inner):
    names = " ".join(f'xmlns:{k}="{v}"' for k, v in xmp.NAMESPACES.items())
    return f'%PDF-1.7\n\xff\n<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF {names}>{inner}</rdf:RDF></x:xmpmeta>\n%%EOF'.encode("ascii", "xmlcharrefreplace")


def test_round_trip_of_all_fields(spark):
    packet = made(spark, xmp.packet, **VALUES)
    assert packet.startswith("<?xpacket begin=")
    got = read(spark, b"%PDF-1.7\n\xe2\xe3\xcf\xd3\n" + packet.encode() + b"\n\xff%%EOF")[0]
    assert {f: got[f] for f in FIELDS} == VALUES


def test_dictionary_round_trip(spark):
    custom = {f: VALUES[f] for f in xmp.CUSTOM}
    got = read(spark, b"%PDF\n" + made(spark, xmp.dictionary, **custom).encode() + b"\n%%EOF")[0]
    assert {f: got[f] for f in FIELDS} == {f: custom.get(f) for f in FIELDS}


def test_empty_fields_make_no_packet(spark):
    assert made(spark, xmp.packet, title="", betrag=None, subject="  ") is None
    assert made(spark, xmp.dictionary, betrag="") is None
    with pytest.raises(ValueError):
        xmp.packet(author=F.lit("x"))


def test_forms_of_other_writers(spark):
    attributes = rdf('<rdf:Description rdf:about="" pdf:Keywords="a, b" pdfx:Betrag="7"/>')
    languages = rdf('<rdf:Description><dc:title><rdf:Alt><rdf:li xml:lang="en">Invoice</rdf:li><rdf:li xml:lang="x-default">Rechnung</rdf:li></rdf:Alt></dc:title></rdf:Description>')
    bag = rdf("<rdf:Description>\n <dc:subject>\n  <rdf:Bag>\n   <rdf:li>strom</rdf:li>\n   <rdf:li>gas</rdf:li>\n  </rdf:Bag>\n </dc:subject>\n</rdf:Description>")
    two = rdf("<rdf:Description><dc:subject></dc:subject></rdf:Description><rdf:Description><dc:subject>spät</dc:subject><pdfx:Fremd>x</pdfx:Fremd></rdf:Description>")
    got = read(spark, attributes, languages, bag, two)
    assert (got[0]["keywords"], got[0]["betrag"], got[0]["title"]) == ("a, b", "7", None)
    assert got[1]["title"] == "Rechnung"
    assert got[2]["subject"] == "strom, gas"
    assert got[3]["subject"] == "spät"


def test_last_packet_and_dictionary_count(spark):
    old, new = rdf("<rdf:Description><pdfx:Betrag>1</pdfx:Betrag><pdfx:Waehrung>USD</pdfx:Waehrung></rdf:Description>"), rdf("<rdf:Description><pdfx:Betrag>2</pdfx:Betrag></rdf:Description>")
    got = read(spark, old + new, old + b"<< /Betrag (3 \\(brutto\\)) /Steuerjahr(2023) >> << /Betrag <FEFF0034002020AC> >>", b"<< /Betrag (a (b) c) /Steuerjahr <32303234> >>")
    assert (got[0]["betrag"], got[0]["waehrung"]) == ("2", None)
    assert (got[1]["betrag"], got[1]["steuerjahr"], got[1]["waehrung"]) == ("4 €", "2023", "USD")
    assert (got[2]["betrag"], got[2]["steuerjahr"]) == ("a (b) c", "2024")


def test_damaged_files_give_nulls(spark):
    whole = rdf("<rdf:Description><dc:subject>x</dc:subject></rdf:Description>")
    bad = [None, b"", b"no PDF", whole[:-30], whole.replace(b"</dc:subject>", b"</dc:sub>"), whole.replace(b">x<", b">\xff\xfe<"), b"<< /Betrag <FEFF00> /Waehrung <FEFFD800> /Steuerjahr (2 >>", whole.replace(b">x<", b">&unknown;<")]
    for row in read(spark, *bad):
        assert [row[f] for f in FIELDS] == [None] * len(FIELDS), row
