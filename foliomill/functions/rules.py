"""Rule tables: which patterns stand for which tag, section and kind of text.

They are plain data and can be replaced by the caller. Patterns follow Java's
syntax with Unicode classes; FLAGS makes them case-insensitive, "^" match at every
line and "." stop at LF only.
"""

from __future__ import annotations

FLAGS = "(?imdU)"

# Terms by type and value, in the order in which tags are listed.
TERMS: dict[str, dict[str, list[str]]] = {
    "ion_form": {
        "H": [r"\bH[- ]?Nafion\b", r"\bprotonated\s+Nafion\b", r"\bH\+\s*form\b"],
        "Li": [r"\bLi[- ]?Nafion\b", r"\blithiated\s+Nafion\b", r"\blithium\s+form\b"],
        "Na": [r"\bNa[- ]?Nafion\b", r"\bsodium\s+type\b", r"\bsodium\s+form\b"],
        "K": [r"\bK[- ]?Nafion\b", r"\bpotassium\s+form\b"],
        "Cs": [r"\bCs[- ]?Nafion\b", r"\bcesium\s+form\b"],
        "Mg": [r"\bMg[- ]?Nafion\b", r"\bmagnesium\s+form\b"],
        "Ca": [r"\bCa[- ]?Nafion\b", r"\bcalcium\s+form\b"],
    },
    "solvent": {
        "EC": [r"\bethylene\s+carbonate\b", r"\bEC\b"],
        "SL": [r"\bsulfolane\b", r"\bSL\b"],
        "NMP": [r"\bNMP\b", r"\bN-methyl-?2-?pyrrolidone\b"],
        "DMF": [r"\bDMF\b", r"\bdimethylformamide\b"],
        "DMA": [r"\bDMA\b", r"\bdimethylacetamide\b"],
        "DMSO": [r"\bDMSO\b", r"\bdimethyl\s+sulfoxide\b"],
        "PC": [r"\bpropylene\s+carbonate\b", r"\bPC\b"],
        "DOL": [r"\bDOL\b", r"\bdioxolane\b"],
        "DME": [r"\bDME\b", r"\bdimethoxyethane\b"],
        "water": [r"\bwater\b", r"\baqueous\b"],
        "ethanol": [r"\bethanol\b", r"\bEtOH\b"],
        "methanol": [r"\bmethanol\b", r"\bMeOH\b"],
        "isopropanol": [r"\bisopropanol\b", r"\b2-propanol\b", r"\bIPA\b"],
    },
    "method": {
        "conductivity": [r"\bconductivit(?:y|ies)\b", r"\bionic\s+conductivity\b"],
        "EIS": [r"\bEIS\b", r"\belectrochemical\s+impedance\b", r"\bimpedance\s+spectroscop"],
        "TGA": [r"\bTGA\b", r"\bthermogravimetric"],
        "TGA-MS": [r"\bTGA[- ]?MS\b", r"\bthermogravimetric.*mass\s+spectrom"],
        "DSC": [r"\bDSC\b", r"\bdifferential\s+scanning\s+calorim"],
        "XRD": [r"\bXRD\b", r"\bX-ray\s+diffraction\b"],
        "WAXD": [r"\bWAXD\b", r"\bwide[- ]angle\s+X-ray\b"],
        "SAXS": [r"\bSAXS\b", r"\bsmall[- ]angle\s+X-ray\b"],
        "SANS": [r"\bSANS\b", r"\bsmall[- ]angle\s+neutron\b"],
        "FTIR": [r"\bFTIR\b", r"\bFT-?IR\b", r"\binfrared\s+spectroscop"],
        "NMR": [r"\bNMR\b", r"\bnuclear\s+magnetic\s+resonance\b"],
        "SEM": [r"\bSEM\b", r"\bscanning\s+electron\s+microscop"],
        "TEM": [r"\bTEM\b", r"\btransmission\s+electron\s+microscop"],
        "AFM": [r"\bAFM\b", r"\batomic\s+force\s+microscop"],
        "swelling": [r"\bswelling\b", r"\buptake\b"],
    },
    "material": {
        "Nafion 115": [r"\bNafion[- ]?115\b"],
        "Nafion 117": [r"\bNafion[- ]?117\b"],
        "Nafion 212": [r"\bNafion[- ]?212\b"],
        "Nafion 211": [r"\bNafion[- ]?211\b"],
        "PVDF": [r"\bPVDF\b", r"\bpolyvinylidene\s+fluoride\b"],
        "PVDF-HFP": [r"\bPVDF[- ]?HFP\b"],
    },
    "battery_role": {
        "electrolyte": [r"\belectrolyte\b", r"\bpolymer\s+electrolyte\b"],
        "separator": [r"\bseparator\b"],
        "binder": [r"\bbinder\b"],
    },
    "sample_type": {
        "membrane": [r"\bmembrane\b"],
        "film": [r"\bfilm\b"],
        "dispersion": [r"\bdispersion\b"],
    },
    "evidence_type": {
        "experimental_data": [r"\bmeasured\b", r"\bprepared\b", r"\bwas\s+studied\b", r"\bexperiment"],
        "numerical_table": [r"\bTable\s+\d+", r"\b\d+(?:\.\d+)?\s*(?:wt\s*%|mol|S\s*cm|mS\s*cm|°C|K)\b"],
        "figure_caption": [r"\bFig\.\s*\d+", r"\bFigure\s+\d+"],
        "method_description": [r"\bwas\s+measured\b", r"\bwere\s+measured\b", r"\bwas\s+prepared\b", r"\bwere\s+prepared\b"],
        "computational": [r"\bDFT\b", r"\bquantum\s+chemical\b", r"\bcalculation"],
        "review_background": [r"\bhas\s+been\s+reported\b", r"\bin\s+the\s+literature\b", r"\breview"],
    },
}

# Headings of sections, the first that matches a line wins.
SECTIONS: dict[str, list[str]] = {
    "abstract": [r"^\s*abstract\b"],
    "introduction": [r"^\s*(?:1\.?\s*)?introduction\b"],
    "experimental": [r"^\s*(?:\d+\.?\s*)?(?:experimental|materials?\s+and\s+methods|methods?)\b"],
    "results": [r"^\s*(?:\d+\.?\s*)?(?:results|results\s+and\s+discussion)\b"],
    "discussion": [r"^\s*(?:\d+\.?\s*)?discussion\b"],
    "conclusions": [r"^\s*(?:\d+\.?\s*)?conclusions?\b"],
    "references": [r"^\s*(?:references|bibliography)\b"],
    "supplementary": [r"^\s*supplementary\b", r"^\s*supporting\s+information\b"],
}
HEADING_CHARS = 80

# Marks of the kinds of chunks.
TABLE_MARK = r"\bTable\s+\d+"
CAPTION_MARK = r"^\s*(?:Fig\.|Figure)\s*\d+"
METHOD_MARK = r"\b(?:experimental|materials?\s+and\s+methods|was\s+measured|were\s+measured)\b"
BASE_CONFIDENCE, CONFIDENCE_STEP = 0.55, 0.15


def rule_rows(terms: dict[str, dict[str, list[str]]] = TERMS) -> list[tuple[int, str, str, str]]:
    """(order, type, value, pattern), one row for each pattern."""
    out = []
    for tag_type, values in terms.items():
        for value, patterns in values.items():
            for pattern in patterns:
                out.append((len(out), tag_type, value, pattern))
    return out
