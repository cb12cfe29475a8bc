"""The citation grammar: one regular expression for each family of citations.

Alternatives are listed longest first wherever one name begins another, and page numbers may not be
followed by a letter or digit. A cheap `needs` pattern spares texts that cannot hold a family.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Abbreviations of reporters, longest first where one begins another.
REPORTERS = (
    "U.S.P.Q.2d", "U.S.", "S. Ct.", "L. Ed. 2d", "L. Ed.", "F.4th", "F.3d", "F.2d", "F. Supp. 3d", "F. Supp. 2d", "F. Supp.", "F. App'x", "Fed. Cl.", "B.R.", "N.E.3d", "N.E.2d", "N.W.2d", "P.3d", "P.2d", "S.E.2d",
    "So. 3d", "So. 2d", "S.W.3d", "S.W.2d", "A.3d", "A.2d", "Cal. Rptr. 3d", "Cal. Rptr. 2d", "Cal. Rptr.", "Cal. 5th", "Cal. 4th", "N.Y.S.2d", "N.Y.2d", "N.Y.3d",
)

# Months and states as statutes abbreviate them.
STATES = ("Cal.", "N.Y.", "Tex.", "Fla.", "Ill.", "Mass.", "Pa.", "Ohio", "Va.", "Wash.", "Del.", "N.J.", "Mich.", "Ga.", "Colo.", "Minn.", "Wis.")

# Signals, longest first where one begins another, with the names that reports use.
SIGNALS = {
    "see generally": "see-generally", "see, e.g.,": "see-eg", "see also": "see-also", "but see": "but-see", "but cf.": "but-cf", "compare": "compare", "accord": "accord", "contra": "contra", "see": "see", "cf.": "cf",
}

# Common names of statutes and the citation each stands for.
POPULAR_NAMES = {
    "Lanham Act": "15 U.S.C. § 1051", "Sherman Act": "15 U.S.C. § 1", "Clayton Act": "15 U.S.C. § 12", "Copyright Act": "17 U.S.C. § 101", "Patent Act": "35 U.S.C. § 1", "Administrative Procedure Act": "5 U.S.C. § 551", "Clean Air Act": "42 U.S.C. § 7401",
    "Digital Millennium Copyright Act": "17 U.S.C. § 512", "ERISA": "29 U.S.C. § 1001", "FOIA": "5 U.S.C. § 552", "Section 230": "47 U.S.C. § 230", "Title VII": "42 U.S.C. § 2000e", "RICO": "18 U.S.C. § 1961",
}

# Amendments and articles by their informal names.
ORDINALS = ("First", "Second", "Third", "Fourth", "Fifth", "Sixth", "Seventh", "Eighth", "Ninth", "Tenth", "Eleventh", "Twelfth", "Thirteenth", "Fourteenth", "Fifteenth", "Sixteenth", "Seventeenth", "Eighteenth", "Nineteenth", "Twentieth", "Twenty-First", "Twenty-Second", "Twenty-Third", "Twenty-Fourth", "Twenty-Fifth", "Twenty-Sixth", "Twenty-Seventh")
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX", "XXI", "XXII", "XXIII", "XXIV", "XXV", "XXVI", "XXVII")


def either(names) -> str:
    return "(?:" + "|".join(re.escape(n).replace("\\ ", " ").replace(" ", r"\s+") for n in names) + ")"


REP = either(REPORTERS)
STOP = r"(?![0-9A-Za-z])"
NOT_A_PARTY = r"(?!(?:See|Cf|But|Accord|Contra|Compare|In|The|Under|As|Id|And|Point|Although|Because|When|While|That|This|Citing|Quoting)\b)"
NAME = r"[A-Z][\w&'’.-]*"
PARTY = rf"{NAME}(?:,? (?:(?:of|the|and|&|for|ex rel\.|de|la) )?{NAME})*"
PAGES = r"[0-9]+(?:[-–—][0-9]+)?(?: n\.[0-9]+)?"
PIN = rf"{PAGES}(?:, {PAGES})*"
SUBSECTIONS = r"(?:\([0-9A-Za-z]{1,5}\))"
SECTION = r"[0-9]+[0-9A-Za-z]*(?:[.-][0-9A-Za-z]+)*"
HISTORY = r"cert\. denied|cert\. granted|aff['’]d|rev['’]d|vacated|remanded|overruled|modified by|abrogated by"


@dataclass(frozen=True)
class Family:
    """A pattern family: its id, the mention type it emits, its expression and what a text must contain."""

    id: str
    kind: str
    pattern: str
    needs: str


FAMILIES = (
    Family("P30", "non_authority", rf"(?<![\w.])(?:R\. at {PAGES}|Appx ?[0-9]+|(?:Blue|Red|Gray|Yellow) Br\.(?: at {PAGES})?|(?:Appellant|Appellee|Petitioner|Respondent)s?['’]s? Br\.(?: at {PAGES})?)", r"R\. at|Appx|Br\."),
    Family("P01", "case", rf"(?<![\w.]){NOT_A_PARTY}{PARTY} v\. {PARTY},\s+[0-9]+\s+{REP}\s+[0-9]+{STOP}(?:, {PIN})?(?:\s+\((?:[^()]*\s)?[0-9]{{4}}\))?", r" v\. "),
    Family("P02", "case", rf"(?<![\w.])(?:{NOT_A_PARTY}{PARTY} v\. {PARTY},\s+(?:No\. [\w:-]+,\s+)?)?[0-9]{{4}}\s+(?:WL|U\.S\. Dist\. LEXIS|U\.S\. App\. LEXIS)\s+[0-9]+(?:, at \*[0-9]+)?(?:\s+\([^()]*[0-9]{{4}}\))?", r" WL | LEXIS "),
    Family("P03", "case", r"(?<![\w.])(?:(?:IPR|PGR|CBM)20[0-9]{2}-[0-9]{5,}|[0-9]+ (?:F\.T\.C\.|S\.E\.C\.|F\.C\.C\. ?R(?:cd|ec)\.?|F\.C\.C\.2d) [0-9]+)", r"IPR|PGR|CBM|F\.T\.C\.|S\.E\.C\.|F\.C\.C\."),
    Family("P04", "case", r"(?<![\w.])(?:ECLI:[A-Z]{2}:[A-Z0-9]+:[0-9]{4}:[A-Z0-9.]+|Case [CT]-[0-9]+/[0-9]{2})", r"ECLI:|Case [CT]-"),
    Family("P05", "case", r"(?<![\w.])App(?:lication)?\. [Nn]os?\. [0-9]+/[0-9]{2}", r"App"),
    Family("P06", "constitutional", r"(?<![\w.])U\.S\. Const\. (?:art\. [IVX]+|amend\. [IVX]+)(?:, § [0-9]+)?(?:, cl\. [0-9]+)?", r"U\.S\. Const\."),
    Family("P08", "constitutional", rf"(?<![\w.]){either(STATES)} Const\. (?:art\. [IVX]+|amend\. [IVX]+)(?:, § [0-9]+)?", r"Const\."),
    Family("P07", "constitutional", rf"(?<![\w-])(?:(?:{'|'.join(reversed(ORDINALS))}) Amendment|Article (?:III|II|IV|VII|VI|V|I){STOP})", r"Amendment|Article "),
    Family("P28", "statute", rf"(?<![\w.])[0-9]+\s+U\.S\.C\.\s+§§\s*{SECTION}{SUBSECTIONS}+(?:(?:, and|,| and) {SUBSECTIONS}+)+", r"U\.S\.C\.\s+§§"),
    Family("P09", "statute", rf"(?<![\w.])[0-9]+\s+U\.S\.C\.\s+(?:§§?\s*)?{SECTION}{SUBSECTIONS}*(?:\s+\([0-9]{{4}}\))?", r"U\.S\.C\."),
    Family("P10", "statute", rf"(?<![\w.]){either(STATES)} (?:[A-Z][a-z.]+ (?:& [A-Z][a-z.]+ )?){{0,3}}(?:Code|Law|Stat\.|Laws|Rev\. Stat\.)(?: Ann\.)? §§? ?{SECTION}{SUBSECTIONS}*", r" §"),
    Family("P11", "statute", rf"(?<![\w.]){either(sorted(POPULAR_NAMES, key=len, reverse=True))}{STOP}", r"Act|ERISA|FOIA|Section 230|Title VII|RICO"),
    Family("P13", "rule", r"(?<![\w.])(?:Fed\. R\. (?:Civ|App|Evid|Crim|Bankr)\. ?P?\.? |Rules )[0-9]+[-–][0-9]+", r"Rules|Fed\. R\."),
    Family("P12", "rule", rf"(?<![\w.])(?:Fed\. R\. (?:Civ\. P\.|App\. P\.|Evid\.|Crim\. P\.|Bankr\. P\.)|S\. Ct\. R\.|Sup\. Ct\. R\.) [0-9]+(?:\.[0-9]+)?{SUBSECTIONS}*", r"Fed\. R\.|Ct\. R\."),
    Family("P14", "regulation", rf"(?<![\w.])[0-9]+\s+C\.F\.R\.\s+(?:§§?\s*|pt\. )?[0-9]+(?:\.[0-9]+)?[0-9A-Za-z-]*{SUBSECTIONS}*(?:\s+\([0-9]{{4}}\))?", r"C\.F\.R\."),
    Family("P15", "regulation", r"(?<![\w.])[0-9]+ Fed\. Reg\. [0-9,]*[0-9](?:, [0-9,]*[0-9])?(?: \([^()]*[0-9]{4}\))?", r"Fed\. Reg\."),
    Family("P16", "legislative", r"(?<![\w.])[0-9]+ Cong\. Rec\. [SHE]?[0-9]+(?: \([^()]*[0-9]{4}\))?", r"Cong\. Rec\."),
    Family("P17", "legislative", r"(?<![\w.])(?:H\.R\.|S\.|H\.) (?:Conf\. )?Rep\. No\. [0-9]+-[0-9]+(?:, at [0-9]+)?(?: \([0-9]{4}\))?", r"Rep\. No\."),
    Family("P18", "legislative", r"(?<![\w.])(?:Hearing (?:on|before)|Markup of|Amendment No\.) [^.;()]{1,120}(?:\([0-9]{4}\)|[0-9]{1,3}(?:th|st|nd|rd) Cong\.(?: \([0-9]{4}\))?)", r"Hearing |Markup |Amendment No"),
    Family("P21", "secondary", rf"(?<![\w.])Restatement \((?:First|Second|Third|Fourth)\) of [A-Z][\w ]*? § {SECTION}(?: cmt\. [a-z])?(?: \([^()]*[0-9]{{4}}\))?", r"Restatement"),
    Family("P20", "secondary", rf"(?<![\w.])[0-9]+ {NAME}(?: (?:& )?{NAME})*, [A-Z][\w ]+ § {SECTION} \([^()]*[0-9]{{4}}\)", r" § "),
    Family("P19", "secondary", rf"(?<![\w.]){NOT_A_PARTY}{NAME}(?: {NAME})*, [^,.;]{{3,120}}, [0-9]+ [A-Z][\w.&' ]*?(?:L\. Rev\.|L\.J\.|J\.L\.|Rev\.) [0-9]+(?:, {PIN})? \([0-9]{{4}}\)", r"L\. Rev\.|L\.J\.|J\.L\.|Rev\."),
    Family("P22", "secondary", r"(?:https?://|www\.)[^\s<>()\"]*[^\s<>()\".,;]", r"http|www\."),
    Family("P24", "short_case", rf"(?<![\w.]){NOT_A_PARTY}{PARTY}, [0-9]+\s+{REP}\s+at\s+{PIN}", r" at "),
    Family("P25", "short_case", rf"(?<![\w.])[0-9]+\s+{REP}\s+at\s+{PIN}", r" at "),
    Family("P26", "supra", rf"(?<![\w.])(?:{NOT_A_PARTY}{PARTY}, )?supra(?: note [0-9]+)?(?:,? at {PIN})?", r"supra"),
    Family("P23", "id", rf"(?<![\w.])[Ii]d\.(?:,? at {PIN})?", r"[Ii]d\."),
    Family("P27", "short_case", r"(?<![\w.])(?:the )?[A-Z][a-z]+ (?:court|standard|doctrine|test)(?![\w])", r" court| standard| doctrine| test"),
    Family("P29", "statute", rf"(?<![\w.§])§ ?{SECTION}{SUBSECTIONS}*", r"§"),
    # looks like a citation, but of a reporter that none of the above knows: for review
    Family("P32", "unknown", r"(?<![\w.])[0-9]+ [A-Z][A-Za-z']*\.(?: ?[A-Z][A-Za-z0-9']*\.| [0-9](?:d|th)){0,3} [0-9]+(?![0-9A-Za-z])(?: \([^()]*[0-9]{4}\))?", r"[0-9] [A-Z]"),
)
TYPES = frozenset(f.kind for f in FAMILIES)
PRIORITY = {f.id: i for i, f in enumerate(FAMILIES)}
