"""Fixed values that results depend on.

Everything in this module is a constant the analysis is defined by: word
lists, rule tables and the whitespace set of Python's ``str.split``.
They are stated plainly, in their natural order, and are shared by the
Spark operators and by the SQL oracles so both sides use the same lists.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: English stop words (the public scikit-learn
# ENGLISH_STOP_WORDS list, 318 words, alphabetical).
# ---------------------------------------------------------------------------
ENGLISH_STOP_WORDS = (
    "a about above across after afterwards again against all almost alone "
    "along already also although always am among amongst amoungst amount an "
    "and another any anyhow anyone anything anyway anywhere are around as at "
    "back be became because become becomes becoming been before beforehand "
    "behind being below beside besides between beyond bill both bottom but "
    "by call can cannot cant co con could couldnt cry de describe detail do "
    "done down due during each eg eight either eleven else elsewhere empty "
    "enough etc even ever every everyone everything everywhere except few "
    "fifteen fifty fill find fire first five for former formerly forty found "
    "four from front full further get give go had has hasnt have he hence "
    "her here hereafter hereby herein hereupon hers herself him himself his "
    "how however hundred i ie if in inc indeed interest into is it its itself "
    "keep last latter latterly least less ltd made many may me meanwhile "
    "might mill mine more moreover most mostly move much must my myself name "
    "namely neither never nevertheless next nine no nobody none noone nor not "
    "nothing now nowhere of off often on once one only onto or other others "
    "otherwise our ours ourselves out over own part per perhaps please put "
    "rather re same see seem seemed seeming seems serious several she should "
    "show side since sincere six sixty so some somehow someone something "
    "sometime sometimes somewhere still such system take ten than that the "
    "their them themselves then thence there thereafter thereby therefore "
    "therein thereupon these they thick thin third this those though three "
    "through throughout thru thus to together too top toward towards twelve "
    "twenty two un under until up upon us very via was we well were what "
    "whatever when whence whenever where whereafter whereas whereby wherein "
    "whereupon wherever whether which while whither who whoever whole whom "
    "whose why will with within without would yet you your yours yourself "
    "yourselves"
).split()

# ---------------------------------------------------------------------------
# FIXED VALUES: the three extra stop lists, one per analysis, as given.
# "topics": LDA tokens and topic naming.  "network": co-occurrence graph.
# "embedding": Word2Vec sentences.
# ---------------------------------------------------------------------------
EXTRA_STOP_WORDS = {
    "topics": [
        "cont", "continued", "page", "mr", "mrs", "dr", "sir",
        "said", "would", "shall", "may", "also", "one", "two",
        "yes", "sir", "think", "know", "say", "right", "see",
        "come", "go", "got", "get", "let", "make", "take",
        "like", "just", "well", "quite", "rather", "much",
        "ee", "ae", "oe", "se", "ne", "re",
    ],
    "network": [
        "cont", "continued", "page", "mr", "mrs", "dr", "sir",
        "said", "would", "shall", "also", "yes", "think",
        "know", "say", "right", "see", "come", "got", "get",
        "let", "make", "take", "like", "just", "well", "quite",
        "ee", "ae", "oe", "se", "ne", "wesa", "img", "ref",
        "did", "does", "don", "going", "went", "told", "asked",
        "time", "way", "thing", "things", "fact", "point",
        "want", "need", "use", "used",
    ],
    "embedding": [
        "cont", "continued", "page", "mr", "mrs", "dr", "sir",
        "said", "would", "shall", "also", "yes", "think",
        "know", "say", "right", "see", "come", "got", "get",
        "let", "make", "take", "like", "just", "well", "quite",
        "ee", "ae", "oe", "se", "ne", "wesa", "img",
    ],
}


def stop_words(kind: str | None = None) -> list[str]:
    """English stop words, plus the extra list named ``kind`` (sorted, unique)."""
    words = set(ENGLISH_STOP_WORDS)
    if kind is not None:
        words |= set(EXTRA_STOP_WORDS[kind])
    return sorted(words)


# ---------------------------------------------------------------------------
# FIXED VALUES: word category rules, in priority order (first match wins).
# ---------------------------------------------------------------------------
CATEGORY_RULES = [
    ("Buildings & Places", [
        "ronan", "point", "ledbury", "tower", "block", "blocks", "building",
        "buildings", "flat", "flats", "floor", "storey", "storeys",
        "estate", "house", "bromyard", "hartopp", "lannoy", "grenfell",
        "newham", "southwark", "hammersmith", "fulham", "wandsworth",
        "lambeth", "london", "canning", "woolwich", "stratford",
    ]),
    ("Structure & Engineering", [
        "wall", "walls", "panel", "panels", "concrete", "steel",
        "joint", "joints", "bolt", "bolts", "strap", "straps",
        "slab", "slabs", "load", "bearing", "structural", "structure",
        "collapse", "cladding", "insulation", "reinforcement",
        "construction", "precast", "mortar", "cement", "crack",
        "flank", "pressure", "stress", "failure", "strength",
        "design", "engineer", "engineering", "architects", "architect",
    ]),
    ("Fire & Safety", [
        "fire", "safety", "smoke", "alarm", "sprinkler", "evacuation",
        "combustible", "flammable", "risk", "hazard", "brigade",
        "compartment", "compartmentalisation", "escape", "emergency",
        "explosion", "gas", "cooker", "heating",
    ]),
    ("People & Organisations", [
        "tenant", "tenants", "resident", "residents", "council",
        "councillor", "minister", "government", "authority",
        "committee", "association", "campaign", "borough",
        "griffiths", "goodfellow", "eveleigh", "pugsley", "watson",
        "webb", "littlewood", "fairweather", "hodge", "pike",
    ]),
    ("Legal & Inquiry", [
        "inquiry", "tribunal", "evidence", "witness", "statement",
        "report", "regulation", "regulations", "compliance",
        "inspection", "certificate", "assessment", "prosecution",
        "solicitor", "counsel", "barrister", "cross", "examination",
    ]),
    ("Theatre & Culture", [
        "play", "theatre", "song", "act", "scene", "projector",
        "audience", "stage", "rehearsal", "production", "joan",
        "jerry", "performers", "drama", "comedy", "music",
    ]),
]
DEFAULT_CATEGORY = "Other"

# FIXED VALUES: probe words for the nearest-neighbour check of word vectors.
PROBE_WORDS = ["ronan", "fire", "tenants", "collapse", "cladding", "safety"]

# ---------------------------------------------------------------------------
# FIXED VALUES: archive series from the source file name, ordered prefix
# rules; the first matching prefix wins, anything else is "WESA".
# ---------------------------------------------------------------------------
SERIES_PREFIXES = [
    ("TBUK", "TBUK"),
    ("VF_NEW", "VF_NEW"),
    ("VF:", "VF_NEW"),
    ("TWA", "TWA"),
]
DEFAULT_SERIES = "WESA"

# FIXED VALUES: block-file layout.
SEPARATOR_CHAR, SEPARATOR_RUN = "=", 20
BLOCK_SEPARATOR = "={20,}"
BODY_RULE = "-{20,}"
HEADER_KEYS = ["ARCHIVE_FOLDER", "DOCUMENT", "DATE", "PLACE", "SOURCE_IMAGES", "PAGES"]
DEFAULT_ARCHIVE = ""
DEFAULT_DATE = "Unknown"
DEFAULT_PLACE = "Not stated"
OUTLIER_TOPIC_NAME = "Outliers / Mixed"
UNASSIGNED = "unassigned"

# FIXED VALUES: Python's str.split()/str.strip() white space, as a regex
# character class body usable by Java regex and RE2 alike.
PY_WHITESPACE = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
