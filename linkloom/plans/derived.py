"""Derived texts: documents of 60 lines made from the part table, which hold every shape the patterns know, and near misses.

The documents table holds only some shapes; these lines bring the others into the queries, alike in Spark and in DuckDB.
A derived document has a negative doc_id; all its numbers follow from that id.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.runtime import table

LINES = [
    "Title page of study SP-{y}-{n}, formerly SP-24-1 or sp-{y}-{n} or X-{y}-{n}",
    "Protocol number PROT-ABC-1{n} replaces PROT-A-12 and prot-abc-1{n}",
    "Registered as NCT{d}; NCT{n} and XNCT{d} are no registry numbers",
    "Source: https://www.example.org/studies/{n}/index.html, or ftp://example.org/{n}",
    "Contents",
    "1 Introduction ........ {a}",
    "2 Methods . . . . {b}",
    "Table {a} Disposition … {c}",
    "1 Introduction",
    "1.{a} Background",
    "see {a}.{b} for details, as defined in {c}.{a}.{b}",
    "the mean was {a}.{b} after the first visit of everybody taking part",
    "see {a}.{b} mg/kg in the text of the next Section {a}",
    "Section {a}.{b} and sect. {c} and Sect {b} and SECTION {a}.{b}.{c}",
    "§ {a}.{b} and §{c}",
    "Table {a}-{b} and Table {a}.{b}.{c}, table {a} in small letters",
    "Table {a}.{b}: Demographic data",
    "Figure {a}.{c} and Figure {L} but figure {L}",
    "Figure {c}: Flow of subjects",
    "Listing {a}.{b} and Listing {c}-{a}",
    "Appendix {a}.{b} and Appendix {L}, APPENDIX {a}",
    "APPENDIX {L}. Sample forms",
    "The protocol was amended; the protocol deviation and per protocol sets",
    "the Protocol. protocols are not counted; this protocol, however",
    "Statistical Analysis Plan (SAP) and SAP v{a}, statistical analysis plan",
    "statistical analysis plan SAP v{a}; Statistical Analysis Plan (sap {a}",
    "Clinical Study Report (CSR) versus the clinical study report of {y}; CSR",
    "clinical study report ( CSR ), CSRs and csr; clinical  study report (CSR)",
    "Integrated Summary of Safety (ISS {a}) and integrated summary of safety",
    "ISS, ISSUE and the Integrated Summary of Efficacy (ISE); ISE; integrated summary of efficacy",
    "integrated summary of efficacy [ISE]",
    "TMX-{a}_{n} and TMX-1234_{n} and XTMXABC-{a}_{n}",
    "see m{b}/25-clin-over/{n} and m7/25-clin/{n} and m{b}/abc",
    "Module {b}.{a}.{c} and Module {b} but Module 6.1",
    "ICH E{a} (R{b}), ICH Q{a}A and ICH X{a}",
    "21 CFR Part 11.{n} and 45 Code of Federal Regulations (CFR) 46 and CFR {n}",
    "the Declaration of Helsinki and the declaration of helsinki of {y}",
    "doi 10.1000/abc.{n}(a) and 10.12/x",
    "Week {a} Visit, Day {b}/Baseline visit and Month {c} Visits; Week {a} only",
    "Form FDA 1572 and form EMA-{n}0A; Form XYZ 12",
    "Site US-{n} and centre {n}; site plan",
    "Batch No. A{y}-{n} and lot B{y}; batch record",
    "MedDRA PT: Headache and MedDRA SOC Vascular; MedDRA version",
    "Sequence 0{n} and seq. 0{n}, sequence {a}",
    "9.{a} Week {a} Visit",
    "As {s} LN, {y} has shown, {s} {y} and May {y} differ",
    "results [{a}] and [{n}] but [12345]",
    "{s} without a year, then {s} and others in {y}; {s} LN, {y}",
    "SP-{y}-{n}: SAP Section {a}.{b} and protocol Table {c}",
    "Study ID SP-{y}-{n} in Protocol TMX-{a}_{n} Section {c}.{b}; Study ID TMX-{a}_{n}",
    "10. REFERENCES",
    "1. {s} LN. A study of dosing. J Test. {y};1:1-9.",
    "{s}  AB. Another title. {y}.",
    "Smith-Jones P. Third title. 1999.",
    "2) Number style entry of {y}",
    "APPENDIX {b} END",
    "After the references {s} LN {y}, SMITH-JONES 1999 and Smith-Joness 1999",
    "Withdrawn ids PROT-ABC-0001, NCT00000001 and SP-2019-001B",
    "SP-2019-001 and XSP-2019-001 and PROT-ABC-0001-2",
    "not closed: statistical analysis plan(SAP",
]
SURNAMES = ["Helget", "Okafor", "Novak", "Tanaka", "Silva"]

_DOC = "CAST(floor(p_partkey / 60.0) AS BIGINT)"
_PARTS = {
    "a": "CAST(doc % 9 + 1 AS STRING)", "b": "CAST(doc % 5 + 1 AS STRING)", "c": "CAST(doc % 7 + 1 AS STRING)", "n": "lpad(CAST(doc % 1000 AS STRING), 3, '0')",
    "y": "CAST(2001 + doc % 20 AS STRING)", "d": "lpad(CAST(doc * 37 % 100000000 AS STRING), 8, '0')", "L": "substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(doc % 26 + 1 AS INT), 1)",
    "s": "CASE doc % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SURNAMES)) + " END",
}


def _line(template: str) -> str:
    pieces = [_PARTS[p[1:-1]] if p[:1] == "{" else f"'{p}'" for p in re.split(r"(\{\w\})", template) if p]
    return f"concat({', '.join(pieces)})"


#: The derived lines as a query that both engines read alike.
DERIVED = (
    "(SELECT -1 - doc AS doc_id, line_no, CASE line_no " + " ".join(f"WHEN {i} THEN {_line(t)}" for i, t in enumerate(LINES)) + " END AS text"
    f" FROM (SELECT {_DOC} AS doc, CAST(p_partkey % 60 AS INT) AS line_no FROM part))"
)


def derived_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, text) of the derived lines."""
    part = table(spark, sf_dir, "part").select(F.expr(_DOC).alias("doc"), F.expr("CAST(p_partkey % 60 AS INT)").alias("line_no"))
    text = F.expr("CASE line_no " + " ".join(f"WHEN {i} THEN {_line(t)}" for i, t in enumerate(LINES)) + " END")
    # the explode keeps the optimizer from copying the long CASE into every filter above it
    return part.select((-1 - F.col("doc")).alias("doc_id"), "line_no", F.explode(F.array(text)).alias("text"))
