"""The catalogue of reference patterns and the predicates that guard some of them."""

from __future__ import annotations

from dataclasses import dataclass

# Pattern shapes, labels and confidences.
_SPECS = [
    ("STUDY_ID_SPONSOR_V1", "STUDY_ID", 0.95, r"(?<![A-Z0-9])([A-Z]{2,5})-(\d{4})-(\d{3,4})(?![A-Z0-9])"),
    ("STUDY_ID_PROTOCOL_V1", "STUDY_ID", 0.97, r"(?<![A-Z0-9])PROT-([A-Z]{2,5})-(\d{4,6})(?![A-Z0-9])"),
    ("STUDY_ID_NCT_V1", "STUDY_ID", 0.99, r"\bNCT\d{8}\b"),
    ("URL_V1", "URL", 0.98, r"https?://[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+[A-Za-z0-9/]"),
    ("SECTION_REF_DOTTED_V1", "SECTION_REF", 0.55, r"(?<![\d.])([1-9]\d*(?:\.\d+){1,4})(?![\d.])"),
    ("SECTION_REF_LABELED_V1", "SECTION_REF", 0.92, r"(?i:Section|Sect\.?|sec\.?)\s+(\d+(?:\.\d+){0,4})"),
    ("SECTION_REF_SIGIL_V1", "SECTION_REF", 0.97, r"§\s*(\d+(?:\.\d+){0,4})"),
    ("TABLE_REF_NUMBERED_V1", "TABLE_REF", 0.96, r"\bTable\s+(\d+(?:[.\-]\d+){0,4})\b"),
    ("FIGURE_REF_NUMBERED_V1", "FIGURE_REF", 0.96, r"\bFigure\s+(\d+(?:[.\-]\d+){0,4})\b"),
    ("FIGURE_REF_LETTER_V1", "FIGURE_REF", 0.93, r"\bFigure\s+([A-Z])\b"),
    ("LISTING_REF_NUMBERED_V1", "LISTING_REF", 0.96, r"\bListing\s+(\d+(?:[.\-]\d+){0,4})\b"),
    ("APPENDIX_REF_NUMBERED_V1", "APPENDIX_REF", 0.96, r"\bAppendix\s+(\d+(?:\.\d+){0,3})\b"),
    ("APPENDIX_REF_LETTER_V1", "APPENDIX_REF", 0.93, r"\bAppendix\s+([A-Z])\b"),
    ("DOC_REF_PROTOCOL_V1", "DOC_REF", 0.70, r"(?<![A-Za-z])(?i:protocol)(?![A-Za-z])"),
    ("DOC_REF_SAP_V1", "DOC_REF", 0.68, r"(?<![A-Za-z])(?:(?i:statistical\s+analysis\s+plan)|SAP)(?![A-Za-z])"),
    ("DOC_REF_CSR_V1", "DOC_REF", 0.68, r"(?<![A-Za-z])(?:(?i:clinical\s+study\s+report)|CSR)(?![A-Za-z])"),
    ("DOC_REF_ISS_V1", "DOC_REF", 0.68, r"(?<![A-Za-z])(?:(?i:integrated\s+summary\s+of\s+safety)|ISS)(?![A-Za-z])"),
    ("DOC_REF_ISE_V1", "DOC_REF", 0.68, r"(?<![A-Za-z])(?:(?i:integrated\s+summary\s+of\s+efficacy)|ISE)(?![A-Za-z])"),
    ("DOC_ID_V1", "DOC_ID", 0.72, r"(?<![A-Za-z0-9])[A-Z]{2,5}-\d{1,3}_\d{1,4}(?![A-Za-z0-9])"),
    ("CTD_LEAF_PATH_V1", "CTD_LEAF", 0.94, r"\bm([1-5])/(\d[a-z0-9\-]*(?:/[a-z0-9\-]+)*)\b"),
    ("CTD_LEAF_MODULE_V1", "CTD_LEAF", 0.95, r"\bModule\s+([1-5])(?:\.(\d+(?:\.\d+){0,3}))?\b"),
    ("EXT_REF_ICH_V1", "EXT_REF", 0.90, r"\bICH\s+([EMQS]\d+[A-Z]?)(?:\s*\((R\d+)\))?"),
    ("EXT_REF_CFR_V1", "EXT_REF", 0.92, r"\b(?:(\d{1,2})\s+(?:Code of Federal Regulations\s*)?)?\(?CFR\)?\s+(?:Part\s+)?(\d+)(?:\.(\d+))?\b"),
    ("EXT_REF_HELSINKI_V1", "EXT_REF", 0.95, r"\b(?i:Declaration of Helsinki)\b"),
    ("EXT_REF_DOI_V1", "EXT_REF", 0.95, r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"),
    ("VISIT_REF_V1", "VISIT_REF", 0.85, r"\b(Week|Day|Month)\s+(\d+)(?:/[A-Za-z]+)?\s+[Vv]isit\b"),
]
#: Off by default.
OPTIONAL_PATTERNS = {"VISIT_REF_V1"}

# The rule recogniser's references, all of confidence 0.80; its 18 rules over tokens as one pattern per label.
NER_SPECS = [
    ("NER_SECTION_REF_V1", "SECTION_REF", r"(?:\b(?i:section|sect\.?|sec\.?)\s+|§\s*)\d+(?:\.\d+){0,4}\b"),
    ("NER_TABLE_REF_V1", "TABLE_REF", r"\b(?i:table)\s+\d+(?:[.\-]\d+){0,4}\b"),
    ("NER_FIGURE_REF_V1", "FIGURE_REF", r"\b(?i:figure)\s+\d+(?:[.\-]\d+){0,4}\b"),
    ("NER_LISTING_REF_V1", "LISTING_REF", r"\b(?i:listing)\s+\d+(?:[.\-]\d+){0,4}\b"),
    ("NER_APPENDIX_REF_V1", "APPENDIX_REF", r"\b(?i:appendix)\s+\d+(?:\.\d+){0,3}\b"),
    ("NER_CTD_LEAF_V1", "CTD_LEAF", r"\b(?i:module)\s+[1-5](?:\.\d+){0,3}\b"),
    ("NER_STUDY_ID_V1", "STUDY_ID", r"\b(?:NCT\d{8}|[A-Z]{2,5}-\d{4}-\d{3,4}|PROT-[A-Z]{2,5}-\d{4,6})\b"),
    ("NER_FORM_REF_V1", "FORM_REF", r"\b(?i:form)\s+(?:(?i:fda|ich|ema)\s+\d{3,4}[A-Z]?|(?:FDA|ICH|EMA)-\d{3,4}[A-Z]?)\b"),
    ("NER_SITE_CODE_V1", "SITE_CODE", r"\b(?i:site|centre|center)\s+(?:[A-Z]{2}-\d{2,4}|\d{2,4})\b"),
    ("NER_IMP_BATCH_V1", "IMP_BATCH", r"\b(?:(?i:batch)\s+(?i:no\.|no|number|#)|(?i:lot))\s+[A-Z0-9]{4,12}(?:-[A-Z0-9]+)?\b"),
    ("NER_AE_CODE_V1", "AE_CODE", r"\b(?i:meddra)\s+(?i:pt|soc|hlgt|llt)\b:?"),
    ("NER_SEQUENCE_REF_V1", "SEQUENCE_REF", r"\b(?i:sequence|seq\.?)\s+\d{4}\b"),
]

# What the groups of each pattern are called, in order.
GROUP_NAMES = {
    "STUDY_ID_SPONSOR_V1": ["sponsor", "year", "seq"], "STUDY_ID_PROTOCOL_V1": ["sponsor", "num"], "SECTION_REF_DOTTED_V1": ["num"], "SECTION_REF_LABELED_V1": ["num"],
    "SECTION_REF_SIGIL_V1": ["num"], "TABLE_REF_NUMBERED_V1": ["num"], "FIGURE_REF_NUMBERED_V1": ["num"], "FIGURE_REF_LETTER_V1": ["num"], "LISTING_REF_NUMBERED_V1": ["num"],
    "APPENDIX_REF_NUMBERED_V1": ["num"], "APPENDIX_REF_LETTER_V1": ["num"], "CTD_LEAF_PATH_V1": ["mod", "subpath"], "CTD_LEAF_MODULE_V1": ["mod", "sub"],
    "EXT_REF_ICH_V1": ["code", "rev"], "EXT_REF_CFR_V1": ["title", "part", "sec"], "VISIT_REF_V1": ["unit", "n"],
}

#: What a text in lower case must hold, at least one of, for a pattern to match at all: a cheap search before the pattern runs.
NEEDS = {
    "STUDY_ID_SPONSOR_V1": ["-"], "STUDY_ID_PROTOCOL_V1": ["prot-"], "STUDY_ID_NCT_V1": ["nct"], "URL_V1": ["://"], "SECTION_REF_DOTTED_V1": ["."],
    "SECTION_REF_LABELED_V1": ["sec"], "SECTION_REF_SIGIL_V1": ["§"], "TABLE_REF_NUMBERED_V1": ["table"], "FIGURE_REF_NUMBERED_V1": ["figure"],
    "FIGURE_REF_LETTER_V1": ["figure"], "LISTING_REF_NUMBERED_V1": ["listing"], "APPENDIX_REF_NUMBERED_V1": ["appendix"], "APPENDIX_REF_LETTER_V1": ["appendix"],
    "DOC_REF_PROTOCOL_V1": ["protocol"], "DOC_REF_SAP_V1": ["statistical", "sap"], "DOC_REF_CSR_V1": ["clinical", "csr"], "DOC_REF_ISS_V1": ["integrated", "iss"],
    "DOC_REF_ISE_V1": ["integrated", "ise"], "DOC_ID_V1": ["_"], "CTD_LEAF_PATH_V1": ["m1/", "m2/", "m3/", "m4/", "m5/"], "CTD_LEAF_MODULE_V1": ["module"],
    "EXT_REF_ICH_V1": ["ich"], "EXT_REF_CFR_V1": ["cfr"], "EXT_REF_HELSINKI_V1": ["helsinki"], "EXT_REF_DOI_V1": ["10."], "VISIT_REF_V1": ["visit"],
    "NER_SECTION_REF_V1": ["sec", "§"], "NER_TABLE_REF_V1": ["table"], "NER_FIGURE_REF_V1": ["figure"], "NER_LISTING_REF_V1": ["listing"], "NER_APPENDIX_REF_V1": ["appendix"],
    "NER_CTD_LEAF_V1": ["module"], "NER_STUDY_ID_V1": ["nct", "-"], "NER_FORM_REF_V1": ["form"], "NER_SITE_CODE_V1": ["site", "cent"], "NER_IMP_BATCH_V1": ["batch", "lot"], "NER_AE_CODE_V1": ["meddra"], "NER_SEQUENCE_REF_V1": ["seq"],
}

# Words near a bare dotted number that make it a section, and what makes it a statistic.
SECTION_CUES = [
    "section", "§", "subsection", "see", "refer", "described in", "defined in", "specified in", "presented in",
    "provided in", "outlined in", "set forth in", "pursuant to", "in accordance with", "according to",
]
STATISTIC = (
    r"(?i)%|\bCI\b|\bp\s*[=<>]|\bn\s*=|±|per\s+\d|/\s*\d|\d{1,3},\d{3}|"
    r"\b(?:years?|yrs?|months?|weeks?|days?|hours?|hrs?|PY|mg|mcg|kg|g|mL|L|mmHg|bpm|score|fold|patients?|subjects?|cells?)\b"
)
# Words after which "protocol" is no document.
PROTOCOL_NEXT = [
    "deviation", "deviations", "deviate", "set", "sets", "violation", "violations", "waiver", "waivers", "amendment",
    "amendments", "amend", "amended", "number", "no", "synopsis", "compliance", "adherence", "specified", "defined",
    "mandated", "required", "population", "eligible",
]
PROTOCOL_PREVIOUS = ["per"]
ACRONYMS = {"DOC_REF_SAP_V1": "SAP", "DOC_REF_CSR_V1": "CSR", "DOC_REF_ISS_V1": "ISS", "DOC_REF_ISE_V1": "ISE"}
SPELLED = {"DOC_REF_SAP_V1": "statistical analysis plan", "DOC_REF_CSR_V1": "clinical study report", "DOC_REF_ISS_V1": "integrated summary of safety", "DOC_REF_ISE_V1": "integrated summary of efficacy"}
CUE_WINDOW, PREVIOUS_WINDOW = 28, 12


@dataclass(frozen=True)
class Pattern:
    id: str
    label: str
    confidence: float
    regex: str
    ordinal: int
    layer: str = "regex"


class Registry:
    """An ordered set of patterns; an id that is registered twice is an error."""

    def __init__(self, patterns: list[Pattern] | None = None):
        self.patterns: dict[str, Pattern] = {}
        for p in patterns or []:
            self.register(p)

    def register(self, p: Pattern) -> None:
        if p.id in self.patterns:
            raise ValueError(f"pattern {p.id} is registered already")
        self.patterns[p.id] = p

    def __iter__(self):
        return iter(self.patterns.values())

    def __getitem__(self, pattern_id: str) -> Pattern:
        return self.patterns[pattern_id]

    def label_for(self, pattern_id: str) -> str:
        return self.patterns[pattern_id].label if pattern_id in self.patterns else "UNKNOWN"


ALL_PATTERNS = [Pattern(i, label, c, rx, n) for n, (i, label, c, rx) in enumerate(_SPECS)]
NER_PATTERNS = [Pattern(i, label, 0.80, rx, 100 + n, "ner") for n, (i, label, rx) in enumerate(NER_SPECS)]


def registry(mode: str = "regex+ner", visits: bool = False) -> Registry:
    """The patterns of a cascade mode: regex, or regex+ner; visit references on request."""
    if mode not in ("regex", "regex+ner"):
        raise ValueError(mode)
    chosen = [p for p in ALL_PATTERNS if visits or p.id not in OPTIONAL_PATTERNS]
    return Registry(chosen + (NER_PATTERNS if mode == "regex+ner" else []))
