"""Cross-document resolution, a row per branch."""

from linkloom.operators.routing import resolve_documents

FILES = ["d/protocol-sp-2026-001.docx", "d/sap-sp-2026-001.docx", "d/csr-sp-2026-001-body.docx", "d/protocol-sp-2026-002.docx", "d/csr-sp-2026-002-body.docx", "d/listing-x.pdf", "e/annual-overview.pdf"]


def test_branches(spark):
    files = spark.createDataFrame([("A", p, k) for k, p in enumerate(FILES)] + [("B", "z/sap-other.docx", 0), ("B", None, 1)], "dossier_id string, source_path string, ord int")
    sap, proto, csr = FILES[1], FILES[0], FILES[2]
    cases = [
        (1, "URL", "", "https://x", None, sap, None, None), (2, "STUDY_ID", "STUDY_ID_NCT_V1", "NCT01234567", None, sap, None, None), (3, "TABLE_REF", "", "--", None, sap, None, None),
        (4, "DOC_REF", "", "Protocol", None, sap, None, proto), (5, "DOC_REF", "", "Protocol", None, proto, None, None), (6, "DOC_REF", "", "brochure", None, sap, None, None),
        (7, "DOC_REF", "", "SAP", None, FILES[3], None, sap), (8, "STUDY_ID", "", "SP-2026-002", None, sap, None, FILES[4]), (9, "TABLE_REF", "", "Table 1", "see protocol SP-2026-002 Table 1", sap, None, FILES[3]),
        (10, "SECTION_REF", "", "Section 6", "the SAP Section 6", csr, None, sap), (11, "DOC_ID", "", "annual overview", None, sap, None, FILES[6]), (12, "TABLE_REF", "", "Table 9", "Table 9", sap, None, None),
        (13, "STUDY_ID", "", "SP-2026-002", None, FILES[4], None, None), (14, "DOC_REF", "", None, None, sap, None, None),
    ]
    refs = spark.createDataFrame([(i, "A", la, p, t, c, s, q) for i, la, p, t, c, s, q, _ in cases], "ref_id int, dossier_id string, label string, pattern_id string, text string, context string, source_path string, qualifier string")
    got = {r.ref_id: r.target for r in resolve_documents(refs, files).collect()}
    assert got == {c[0]: c[-1] for c in cases}
    assert resolve_documents(refs.limit(0), files).count() == 0
