"""Fixed values of the document rules."""

#: Categories in their order, each with the substrings that mark it.
CATEGORIES = {
    "rechnung": ["rechnung", "invoice", "rechnungsnummer", "rechnungsbetrag", "zahlbar"],
    "vertrag": ["vertrag", "vereinbarung", "contract", "laufzeit", "kündigung"],
    "steuer": ["steuer", "finanzamt", "steuernummer", "steuererklärung", "einkommensteuer"],
    "versicherung": ["versicherung", "police", "versicherungsnummer", "beitrag", "prämie"],
    "bank": ["bank", "konto", "kontoauszug", "überweisung", "iban", "bic"],
    "gehalt": ["gehalt", "lohn", "gehaltsabrechnung", "brutto", "netto", "lohnabrechnung"],
    "arzt": ["arzt", "patient", "diagnose", "rezept", "krankenhaus", "praxis"],
    "handwerker": ["handwerker", "reparatur", "montage", "material", "arbeitslohn"],
    "energie": ["strom", "gas", "energie", "verbrauch", "zählerstand", "kwh"],
    "telefon": ["telefon", "mobilfunk", "internet", "tarif", "anschluss"],
}
#: Words that carry no topic.
STOP_WORDS = [
    "der", "die", "das", "und", "in", "zu", "den", "von", "ist", "mit", "sich", "des", "auf", "für", "nicht", "ein", "eine",
    "als", "auch", "es", "an", "werden", "aus", "er", "hat", "dass", "sie", "nach", "wird", "bei", "einer", "um", "am", "sind",
    "noch", "wie", "einem", "über", "so", "zum", "kann", "nur", "ihr", "seine", "ich", "oder", "aber", "vor", "zur", "bis",
    "mehr", "durch", "man", "sehr", "diese", "wenn", "war", "haben", "wurde", "alle", "können", "diesem", "dieser",
]
#: Months in their order.
MONTHS = ["januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"]
#: Line marks of a model's answer and the metadata keys they fill.
ANSWER_FIELDS = {
    "KATEGORIE:": "subject", "KORRESPONDENT:": "korrespondent", "BETRAG:": "betrag", "WAEHRUNG:": "waehrung",
    "MWST:": "mwst_satz", "STEUERJAHR:": "steuerjahr", "ZUSAMMENFASSUNG:": "description",
}
#: Answers that stand for no value.
NO_VALUE = ["UNBEKANNT", "KEINE", "N/A", "-", ""]
#: Characters that no name may hold.
INVALID = '<>:"/\\|?*'
