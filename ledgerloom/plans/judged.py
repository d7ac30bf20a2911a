"""Queries of the normal forms and judgements of printed texts, with the values that each text must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import judgements as J
from ..functions import text as T
from .probes import probe

_r = lambda f: lambda x: F.round(f(x), 6)

probe(
    "folded_forms",
    {"words": T.fold, "spaces": T.fold_spaces, "upper": T.upper_words, "upper_kept": T.upper_spaces, "compact": T.upper_key, "dates": T.fold_dates, "identifier": T.identifier, "value": T.field_value, "anchor": T.anchor_token, "shape": T.structural_shape},
    [
        ("Été  à l'Œuvre ﬁn {k}", "ete a l uvre fin {k}", "ete a l'uvre fin {k}", "ETE A L UVRE FIN {k}", "ETE A L'ŒUVRE FIN {k}", "ETEALUVREFIN{k}", "ete a l uvre fin {k}", "ÉTÉÀL'ŒUVREFIN{k}", "etealœuvrefin{k}", "etealœuvrefin", "A A A'A A 9"),
        ("ＡＢ-12/03.24", "ab 12 03 24", "ab-12/03.24", "AB 12 03 24", "AB-12/03.24", "AB120324", "ab-12/03.24", "ＡＢ-12/03.24", "ab120324", "", "A-9/9.9"),
        ("", "", "", "", "", "", "", "", "", "", ""),
        (None, "", "", "", "", "", "", "", "", "", ""),
        ("Cmd N° 4 500-A", "cmd n 4 500 a", "cmd n 4 500-a", "CMD N 4 500 A", "CMD N° 4 500-A", "CMDN4500A", "cmd n 4 500-a", "CMDN°4500-A", "cmdn4500a", "cmdna", "A A° 9 9-A"),
    ],
)

probe("party_names", {"quality": _r(J.party_name_quality), "company": _r(J.company_name_quality), "strength": _r(J.party_name_strength), "bad": J.bad_party_name}, [
    ("ACME SARL", round(0.55 + 8 / 10 * 0.45, 6), round(0.50 + 8 / 12 * 0.42 + 0.12, 6), 4.8, False),
    ("contact@acme.fr", 0.0, 0.0, 0.5, True),
    ("01 23 45 67 89", 0.0, 0.0, -10.0, True),
    ("Adresse de livraison", 0.05, 0.05, -1.5, True),
    ("12 rue des Lilas", 0.15, 0.05, -1.0, True),
    ("69000 Lyon", 0.15, 0.05, 1.5, True),
    ("Rue du Port", 0.08, 0.08, -1.0, False),
    ("Date : 12/05/2024", 0.1, round(0.50 + 4 / 17 * 0.42, 6), -2.5, True),
    ("X1", 0.2, 0.15, 1.8, False),
    ("", 0.0, 0.0, -10.0, True),
    ("Fournisseur", 1.0, round(0.50 + 11 / 12 * 0.42, 6), 0.5, True),
])

probe("order_number_types", {"typed": J.order_number_type, "corroborates": J.corroborating, "candidate": J.order_candidate}, [
    ("PO-{k}/2024", True, True, True), ("tel 0123456", False, True, True), ("+33 12 345 678", False, True, True), ("01 02 03 04 05", False, True, True), ("1 079,10", False, False, True),
    ("12/05/2024", True, False, False), ("reprise le 5 janvier 2024", True, False, False), ("", False, False, False), ("a@b.fr", False, False, False), ("4500 RUE 12", True, True, False),
])

probe("charge_kinds", {"kind": J.charge_kind, "fee": J.fee_kind}, [
    ("Frais de port {k}", "shipping", "shipping"), ("Port", "shipping", "shipping"), ("Eco-participation", "environmental_fee", "environmental_fee"), ("DEEE 0,12", "environmental_fee", "environmental_fee"), ("Taxe TGAP", "tax", "tax"),
    ("Total hors taxes", None, None), ("Frais de dossier", "surcharge", "surcharge"), ("Autres frais", None, "surcharge"), ("Pompe {k}", None, None), ("Passeport", None, None), ("Shipping cost", "shipping", "shipping"), ("", None, None),
])

probe("address_texts", {"postal": J.address_line, "meta": J.metadata_line, "street": J.street_like, "named_so": J.name_is_address, "safe": J.safe_complement}, [
    ("12 rue de la Paix", True, False, True, True, True), ("69000 Lyon", True, False, False, False, False), ("ZAC des Pins", True, False, False, True, True), ("Tel: 01 02 03 04 05", False, True, False, False, True),
    ("Télécopie 12", False, False, False, False, True), ("Bâtiment C", True, False, False, False, True), ("SOCIETE DU BATIMENT", False, False, False, False, True), ("Boulevard Foch", True, False, True, False, True),
    ("Contact : M. X", False, True, False, True, True), ("Pompe 12345678", False, False, False, False, False), ("Merci de livrer", False, True, False, True, True), ("", False, False, False, False, False),
])

probe("table_stops", {"stop": J.table_stop, "order": J.order_context, "noise": J.garbage_token}, [
    ("Total HT 12,00", True, False, False), ("Sous-total", True, False, False), ("Franco Montant HT Net 95.48", True, False, False), ("Adresse de livraison", True, False, False), ("SIREN 123", True, False, False),
    ("Pompe de relevage", False, False, False), ("Bon de commande {k}", False, True, False), ("---", False, False, True), ("-", False, False, False), ("#a######", False, False, True),
])

probe("item_codes", {"code": J.item_code, "reference": lambda x: J.reference_cell(x)["reference"], "description": lambda x: J.reference_cell(x)["description"], "valid": J.valid_reference}, [
    ("AB-{k}", True, "AB-{k}", None, True), ("12/05/2024", False, None, "12/05/2024", False), ("1234 567 89", False, "123456789", None, True), ("Pompe AB1234 verte", False, "AB1234", "Pompe verte", True), ("|871234|", True, "871234", None, True),
    ("DEVIS", False, None, "DEVIS", False), ("12", False, None, "12", False), ("", False, None, None, False),
])

probe("party_shapes", {"person": J.person_like, "organisation": J.organisation_like, "repeated": J.repeated_name, "agency": lambda x: J.valid_code(x), "explicit": lambda x: J.valid_code(x, explicit=True)}, [
    ("Jean Dupont", True, False, False, True, True), ("SAS Dupont", False, True, False, True, True), ("ISERBA ISERBA", False, True, True, True, True), ("AG12", False, False, False, True, True), ("69000", False, False, False, False, True),
    ("123456789", False, False, False, False, False), ("CEDEX", False, False, False, False, False), ("Dupont", False, False, False, True, True), ("", False, False, False, False, False),
])

probe("delivery_checks", {"crossed": lambda x: J.crosses_columns(x), "phone": lambda x: J.contact_number(x, F.lit("01 02 03 04 05")), "suspicious": lambda x: J.suspicious_delivery(F.lit(""), F.lit(""), x), "in_source": lambda x: J.source_contains(F.lit("PO-123"), x), "lost": lambda x: J.source_lost_separator(F.lit("12-3456789012"), x)}, [
    ("69000 Lyon 13001 Marseille", True, False, True, False, False), ("BP 61178 69000 Lyon", False, False, True, False, False), ("Ligne\nTel 0102030405", False, True, False, False, False), ("Siège social", False, False, True, False, False),
    ("Votre PO -123.", False, False, False, True, False), ("X/PO-123", False, False, False, False, False), ("PO-123/2", False, False, False, False, False), ("po-123)", False, False, False, True, False), ("12 3456789012", False, False, False, False, True),
])

probe("text_pieces", {"lines": T.cell_lines, "unique": lambda x: T.distinct_folded(T.cell_lines(x)), "label": lambda x: T.after_label(x, "commande n", "du|le"), "legal": lambda x: J.legal_footer(F.lit(""), x), "backed": lambda x: J.backed_number(F.lit("10"), x), "spacing": T.line_spacing}, [
    ("10 A  b\n a B ", ["10 A b", "a B"], ["10 A b", "a B"], None, False, True, "10 A b\na B"), ("x\n\nX\ny", ["x", "X", "y"], ["x", "y"], None, False, False, "x\n\nX\ny"), ("Commande n: 45 du 3", ["Commande n: 45 du 3"], ["Commande n: 45 du 3"], "45", False, False, "Commande n: 45 du 3"),
    ("SIRET 123 RCS Paris", ["SIRET 123 RCS Paris"], ["SIRET 123 RCS Paris"], None, True, False, "SIRET 123 RCS Paris"), ("soupape 10", ["soupape 10"], ["soupape 10"], None, False, False, "soupape 10"), ("10) vis", ["10) vis"], ["10) vis"], None, False, True, "10) vis"), ("100 vis", ["100 vis"], ["100 vis"], None, False, False, "100 vis"),
], {"label": "VARCHAR"})

probe("scoped_paths", {"inside": lambda x: J.path_in_scope(x, F.array(F.lit("totals.*"), F.lit("lines[*].sku"), F.lit("number"))), "line_item": lambda x: J.line_item_field(F.lit("LABEL"), x)}, [
    ("totals.net", True, False), ("lines[12].sku", True, True), ("lines[12].name", False, True), ("number", True, False), ("numbers", False, False), ("doc.LINE_ITEMS[0].x", False, True),
])
