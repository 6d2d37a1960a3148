"""What ties the jobs to one kind of publication: patterns and small tables, all of them parameters.

The patterns and names below are fixed values of the publication the fixtures come from; another publication brings
another Profile. They are written for Java's regular expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

_MONTH = r"(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|0CT|NOV|DEC)"


@dataclass(frozen=True)
class Profile:
    blank: str = r"(?i)INTENTIONALLY\s+BLANK"
    specimen: str = r"(?i)\bAD\s*([23])\s*-?\s*DNXX\b"
    section_title: str = r"(?:(DN[A-Z]{2})\s+)?AD\s+([23]\.\d{1,2})\s+([A-Z][A-Z0-9 /\-&()]+)"
    section_header: str = r"(?:(DN[A-Z]{2})\s+)?AD\s+([23]\.\d{1,2})\b\s*([A-Z][A-Z0-9 /\-&()]*)?"
    index_page: str = r"(?i)CHARTS?\s+RELATED\s+TO\s+AN?\s+(?:AERODROME|HELIPORT)"
    front_header: str = r"\b(GEN|ENR|AD)\s*0\.\d{1,2}\s*-\s*\d+"
    intro_header: str = r"\bAD\s*1\.\d{1,2}\s*-\s*\d+"
    route_header: str = r"\bENR\s*(\d)\.\d{1,2}\s*-\s*\d+"
    general_header: str = r"\bGEN\s*(\d)\.\d{1,2}\s*-\s*\d+"
    #: page furniture; a line is dropped only if nothing else is on it
    chrome: tuple[str, ...] = (
        r"\bAD\s*[23]\s*-?\s*DN[A-Z]{2}\s*-?\s*\d+\b",
        rf"\b\d{{1,2}}\s+{_MONTH}\s+\d{{2}}\b",
        rf"\b\d{{1,2}}\s+{_MONTH}\s+\d\s+\d\b",
        rf"\b\d{{1,2}}\s+{_MONTH}\d{{2}}\b",
        rf"\b{_MONTH}\d{{2}}\b",
        r"(?i)\bNIGERIA\s+AIP\b",
        r"(?i)\bNIGERIAN?\s+AIRSPACE\s+MANAGEMENT\s+AGENCY\b",
        r"(?i)\b(?:AIRAC|AIP)\s+AMDT\s+\d{1,3}(?:\s*/{1,2}\s*\d{2,4}(?:\s+\d{1,2})?)?\b",
    )
    excluded_sections: tuple[str, ...] = ("2.22",)
    #: title and reprinted header rows of a table that end up in its cells
    table_furniture: tuple[str, ...] = (
        r"(?i)\bDN[A-Z]{2}\s+AD\s*2\.14\s+APPROACH\s+AND\s+RUNWAY\s+LIGHTING\b",
        r"(?is)\bRWY\s+APCH\s+LGT\b.*?\b1\s+2\s+3\s+4\s+5\s+6\s+7\s+8\s+9(?:\s+10)?\b",
    )
    heading: str = r"^\s*(\d\.\d+(?:\.\d+)+)\s+([A-Z].{0,80}?)\s*$"
    obstacle_row: str = r"\d{6}(?:\.\d+)?[NS]\s"
    section_names: dict[str, str] = field(
        default_factory=lambda: {
            "2.1": "location indicator and name",
            "2.2": "geographical and administrative data",
            "2.3": "operational hours",
            "2.4": "handling services and facilities",
            "2.5": "passenger facilities",
            "2.6": "rescue and fire fighting services",
            "2.7": "seasonal availability and clearing",
            "2.8": "aprons, taxiways and check locations",
            "2.9": "surface movement guidance and markings",
            "2.10": "aerodrome obstacles",
            "2.11": "meteorological information",
            "2.12": "runway physical characteristics",
            "2.13": "declared distances",
            "2.14": "approach and runway lighting",
            "2.15": "other lighting and secondary power supply",
            "2.16": "helicopter landing area",
            "2.17": "ATS airspace",
            "2.18": "ATS communication facilities",
            "2.19": "radio navigation and landing aids",
            "2.20": "local aerodrome regulations",
            "2.21": "noise abatement procedures",
            "2.22": "flight procedures",
            "2.23": "additional information",
        }
    )
    # The header of an instrument approach (runway, aid), and the headings of its parts
    approach_header: str = r"(?i)Instrument\s+approach\s+procedures?\s+for\s+RWY\s*(\d\s*\d\s*[LRC]?)\s+base\s*d?\s+on\s+([^\n0-9.]{2,80})"
    approach_parts: tuple[tuple[str, str], ...] = (
        ("holding", r"holding\s+procedures?"),
        ("letdown", r"letdown\s+procedures?"),
        ("missed", r"(?:on\s+)?missed\s+approach(?:\s+procedure)?"),
    )
    # Numbered headings that end the last approach; words that end a part; what only page furniture prints
    after_approaches: tuple[str, ...] = ("Approach minima", "Takeoff Minima", "Airport Operating Minima", "Radar Procedures", "Procedures for VFR", "PBN Procedure")
    after_part: tuple[str, ...] = (
        "Approach minima",
        "OCA/H (ft)",
        "RWY AID OCA",
        "AIRAC AMDT",
        "Circling OCA",
        "Glide path inoperative",
        "GP INOP",
        "Designator",
        "Instrument approach procedure",
        "Airport Operating Minima",
        "Delta Operator",
        "Delta Arrival",
        "Delta Departure",
        "Takeoff Minima for Rwy",
        "Takeoff Minima for Runway",
        "Aircraft category",
    )
    page_marks: tuple[str, ...] = (
        "NIGERIAN AIRSPACE MANAGEMENT AGENCY",
        r"AD 2-DN[A-Z]{2}-\d+",
        r"\d{2} [A-Z]{3} \d{2}",
        "NIGERIA AIP",
        "FLIGHT PROCEDURES INSTRUMENT APPROACH",
        r"^\s*FLIGHT\s+PROCEDURES\s*$",
    )
    # Words of a request and the aid of an approach that they stand for
    approach_aids: tuple[tuple[str, str], ...] = (("vor", "vor"), ("vor/dme", "vor"), ("ils", "ils"), ("loc", "ils"), ("rnav", "rnav"), ("gnss", "rnav"), ("rnp", "rnav"), ("ndb", "ndb"))
    # The number before a part's heading, the number of any section, the number of a major one, and a row of
    # a minima table
    part_number: str = r"\d\.\d+(?:\.\d+){1,4}\s+"
    section_number: str = r"\b\d+\.\d+(?:\.\d+){1,4}\b"
    major_number: str = r"\d\.\d+(?:\.\d+)*\s+"
    minima_row: str = r"\b[A-D]\s+\d{3,4}(?:\s*\(\d{2,4}\))?\s+\d{3,4}\b"
    # Headings that are answered as they stand and the words that a question must hold; where such a text
    # ends; what only page furniture prints in it
    info_headings: tuple[tuple[str, str], ...] = (
        ("runway in use", r"2\.22\.2\s+Runway\s+in\s+use"),
        ("general", r"2\.22\.1\s+General"),
        ("radar", r"2\.22\.\d+\s+Radar\s+Procedures"),
        ("vfr minima", r"2\.22\.\d+(?:\.\d+)?\s+VFR\s+weather\s+minima"),
        ("vfr", r"2\.22\.\d+\s+Procedures\s+for\s+VFR\s+flights"),
    )
    info_ends: tuple[str, ...] = (r"2\.22\.\d+(?:\.\d+)*\s+[A-Z]", r"Instrument\s+approach\s+procedures?\s+for\s+RWY")
    info_furniture: tuple[str, ...] = (r"AD\s*2-DN[A-Z]{2}-\d+", "NIGERIAN AIRSPACE MANAGEMENT AGENCY", r"AIRAC\s+AMDT[^\n]*", r"\b2\.22(?:\.\d+)+\b")
    # How the text of an area begins, the heading after a table of areas, the column heads that end up at the end of a row, a position given
    # by a navaid, and a name that is a designation
    area_openings: tuple[str, ...] = (r"A\s+circle", r"Area\s+(?:bounded|within)", r"It\s+is\b", r"Line\s+joining", r"NAF\s+Local", r"DANA\s+Training", r"\(?[a-z]\)", r"Military\s+Restricted")
    area_next: str = r"\s*5\.1\.\d+\s+(?:PROHIBITED|RESTRICTED|DANGER|MILITARY|ADJOINING)[A-Z\s]*"
    area_columns: tuple[str, ...] = (
        r"Identification,?\s*name\s*and\s*hazard",
        r"Lateral\s+limits?",
        r"Upper\s+limit",
        r"Lower\s+limit",
        r"Type\s+of\s+restriction",
        r"Activation\s+Hours?",
        "Remarks",
        "coordinates",
        "restriction",
        r"[\d\s]{3,12}",
    )
    area_navaid: tuple[str, ...] = (
        r"\b(?:VOR|DME|NDB|VOR/DME|TACAN)\b(?=.*\b(?:radial|R\s?\d{3}|arc|NM|north|south|east|west)\b)",
        r"\b(?:radial|R\s?\d{3}\s*°?|arc)\b(?=.*\b(?:VOR|DME|NDB)\b)",
    )
    area_designation: str = r"^((?:NAF|DANA|Military|Air Force)\s+[A-Za-z0-9 /]{3,48}?)(?=[.;:]|\s+(?:Line|It\s+is|Area\s+[A-Z]\b|established))"
    # A heading that names an airspace, and the kind alone on the next line
    airspace_heading: str = r"^([A-Z][A-Za-z' ]{1,28}?)\s+(?:Flight\s+Information\s+Region|Terminal\s+Control\s+Area|Control\s+Area)(?:\s*\((?:FIR|TMA|CTA|UIR)\))?\s*$"
    airspace_kind: str = r"^\((?:FIR|UIR|TMA|CTA)\)$"
    scope_kinds: tuple[str, ...] = ("AD", "ENR_AREA", "ENR_POINT", "ENR_ROUTE", "ENR_AIRSPACE", "ENR_NAVAID", "ENR_FRA_DCT", "GEN")
    #: unit suffixes of record keys in the order they are shown, and how
    units: tuple[tuple[str, str], ...] = (
        ("m", "m"),
        ("ft", "ft"),
        ("km", "km"),
        ("nm", "NM"),
        ("mhz", "MHz"),
        ("khz", "kHz"),
        ("deg", "°"),
        ("kg", "kg"),
        ("lb", "lb"),
        ("t", "t"),
        ("c", "°C"),
        ("f", "°F"),
    )
    distances: tuple[tuple[str, str, str], ...] = (
        ("tora_m", "TORA", "take-off run available"),
        ("toda_m", "TODA", "take-off distance available"),
        ("asda_m", "ASDA", "accelerate-stop distance available"),
        ("lda_m", "LDA", "landing distance available"),
    )
    entity_fields: tuple[tuple[str, str], ...] = (
        ("family", "Type of area"),
        ("name", "Name"),
        ("upper_limit", "Upper limit"),
        ("lower_limit", "Lower limit"),
        ("lateral_limits", "Lateral limits"),
        ("vertical_limits", "Vertical limits"),
        ("position", "Position"),
        ("routes", "ATS route(s)"),
        ("fra_relevance", "FRA relevance"),
        ("remarks", "Remarks"),
        ("airspace_class", "Class of airspace"),
        ("ats_unit", "ATS unit"),
        ("languages", "Languages"),
        ("hours", "Hours of service"),
        ("frequencies", "Frequency"),
        ("parent", "Part of"),
        ("note", "Note"),
        ("station", "Station"),
        ("navaid_type", "Type"),
        ("frequency", "Frequency"),
        ("elevation", "DME antenna elevation"),
        ("point_sequence", "Significant points"),
        ("navigation_spec", "Navigation specification"),
        ("dct", "Direct routing"),
        ("availability", "Availability"),
    )


AIP = Profile()
