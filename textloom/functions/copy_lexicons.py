"""Fixed values of the copy rules: lists and patterns that results depend on. All are defaults of parameters.

Patterns are read by Java and by Python alike."""

# Typographic marks and what is written for them.
MARKS = {
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-",
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'",
    "“": '"', "”": '"', "„": '"', "″": '"',
    "…": "...", "\u00a0": " ", "\u2009": " ", "\u202f": " ", "\u200b": "",
}

# Acronyms as they are written, by the ways they occur.
DOTTED = (
    (r"\bU\s*\.\s*S\s*\.?\b", "US"), (r"\bU\s*\.\s*K\s*\.?\b", "UK"), (r"\bU\s*\.\s*N\s*\.?\b", "UN"),
    (r"\bE\s*\.\s*U\s*\.?\b", "EU"), (r"\bU\s*\.\s*A\s*\.\s*E\s*\.?\b", "UAE"), (r"\bR\s*s\b", "Rs"),
)
ALWAYS_UPPER = ("us", "uk", "uae", "eu", "un", "pm", "cm", "rbi", "cji", "gdp", "ai", "isro", "nato", "mea", "icc")
LONG_FORMS = {
    "United Nations": "UN", "United States": "US", "European Union": "EU", "prime minister": "PM", "chief minister": "CM",
    "Board of Control for Cricket in India": "BCCI", "International Cricket Council": "ICC",
}
PROPER_NOUNS = (
    "india", "indian", "iran", "israel", "china", "russia", "ukraine", "pakistan", "uae", "saudi", "congress", "bjp",
    "modi", "trump", "rahul", "gandhi", "bbc", "aljazeera", "guardian",
)

# publishers' names within texts and at the end of titles.
PAPERS = r"(?:The\s+Times\s+of\s+India|Times\s+of\s+India|India\s+Today|BBC\s+News|Al\s*Jazeera)"
TITLE_ENDS = (r"\s*[|\-]\s*(?:bbc|reuters|guardian|al\s*jazeera|the\s*hindu|toi|times\s*of\s*india)\s*$", r"\s+live\s+updates?\s*$")

# Words that stay small in a title, and verbs after which a comma becomes a colon.
SMALL_WORDS = ("a", "an", "the", "and", "but", "or", "for", "nor", "on", "at", "to", "by", "of", "in", "with", "against", "as", "into", "from", "up", "out", "over")
COLON_VERBS = ("escalates", "intensifies", "deepens", "widens", "triggers", "raises", "sparks")

# Parts of a sentence that tell what it is about. They count anywhere, inside words too.
ACTION_VERBS = (
    "hits", "hit", "faces", "face", "surges", "surge", "falls", "fall", "widens", "widen", "rises", "rise", "tightens", "tighten",
    "warns", "warn", "vows", "vow", "pushes", "push", "blocks", "block", "approves", "approve", "orders", "order", "targets", "target",
    "slams", "slam", "rejects", "reject", "backs", "back", "sues", "sue", "asks", "ask", "announces", "announce", "jokes", "joke",
    "jolts", "jolt", "squeezes", "squeeze", "halts", "halt", "scrambles", "scramble", "opens", "open", "launches", "launch",
    "soars", "soar", "plunges", "plunge", "cuts", "cut", "rocks", "rock", "empties", "empty", "deepens", "deepen",
)
ONGOING = (
    "war", "conflict", "talks", "clashes", "clash", "operation", "probe", "investigation", "search", "rescue", "ceasefire",
    "negotiation", "standoff", "strike", "bombing", "protest", "hearing", "case", "crisis", "exchange", "campaign", "offensive",
)
CONSEQUENCE = (
    "expected", "likely", "could", "may", "will", "pressure", "impact", "risk", "debate", "scrutiny", "jobs", "investment",
    "expansion", "growth", "costs", "prices", "strategy", "focus", "next", "ahead", "boost", "fallout", "warning",
)
GENERIC_STARTS = ("this development", "this move", "this comes amid", "meanwhile", "in a major move", "here is why")
GENERIC_PHRASES = ("this development", "this comes amid", "this move", "this strategy", "this reflects", "officials said", "the development is likely")
HOOKS = (
    "warning", "surge", "slump", "standoff", "deadline", "setback", "boost", "risk", "impact", "pressure", "escalation", "breakthrough",
    "turning", "crunch", "shock", "chaos", "row", "jolt", "scramble", "fallout", "squeeze", "blow", "flashpoint", "alert", "rattle", "hit", "plunge",
)
VAGUE_MOVE = r"^(?:this (?:development|move|scrutiny|situation)|the move)\s+(?:could|may|might)\s+(?:impact|affect|signal)\b"
WEAK_ENDINGS = (
    r"^(?:this|the)\s+(?:development|move|situation|decision|scrutiny|incident|case|trend|shift)\s+(?:could|may|might|would|is likely to)\b",
    r"^(?:this|the)\s+(?:development|move|situation|decision|incident|case|trend|shift)\s+(?:highlights|highlighted|underscores|underscored|reflects|reflected|shows|showed|signals|signalled)\b",
    r"^(?:it|this)\s+(?:may|might|could)\s+(?:signal|highlight|underscore|reflect)\b",
    r"\b(?:regional dynamics|broader tensions|wider tensions|broader concerns|larger questions)\b",
)

# Ends of a text whose last clause was cut.
_LINKS = "in|on|at|to|for|from|with|by|of|as|into|over|under|about|between|through|across|and|or|but|so|yet"
_MOVES = "comes|came|falls|fell|rises|rose|surges|surged|jumps|jumped|opens|opened|follows|followed|starts|started"
_WHEN, _WHOSE = "as|after|before|because|since|while|when|if", "the|a|an|his|her|their|its|this|that"
UNFINISHED_WORDS = (
    "global", "international", "national", "domestic", "regional", "local", "central", "federal", "potential", "ongoing", "various", "several",
    "multiple", "other", "such", "key", "major", "minor", "recent", "general", "overall", "total", "annual", "monthly", "daily", "initial", "final",
    "further", "additional", "economic", "political", "social", "financial", "military", "digital", "senior", "junior", "former", "current", "upcoming",
    "alleged", "possible", "likely", "rising", "growing", "broader", "wider",
    "the", "a", "an", "this", "that", "these", "those", "his", "her", "their", "its",
)
WHOLE_COMPOUNDS = ("runner-up", "follow-up", "build-up", "set-up", "start-up", "stand-off", "cease-fire", "year-old", "year-olds", "years-old")
UNFINISHED = (
    rf"(?<![a-z])(?:{'|'.join(UNFINISHED_WORDS)})\.$",
    rf"\b(?:{_LINKS})\.$",
    rf"\b(?!(?:{'|'.join(WHOLE_COMPOUNDS)})\.$)[a-z]{{2,}}-[a-z]{{2,}}\.$",
    r"\b(?:that|which|where|whose|whom|when|who)\s+[a-z.&]{1,5}\.$",
    r",\s+(?:a|an|the)\s+(?:move|step|decision|measure|gesture|sign|shift|development|bid|push|ploy|effort)\.$",
    rf"\b(?:{_LINKS})\s+(?:the|a|an|his|her|their|its|this|that|they|he|she|we|you)\.$",
    rf"\b(?:{_MOVES})\s+(?:{_WHEN})\s+(?:{_WHOSE})?\s*(?:[a-z0-9.-]+\s*){{0,2}}\.$",
)
LAST_LINK = rf"\b(?:{_LINKS})\.?$"
BROKEN = (
    rf"\b(?:{_MOVES})\s+(?:{_WHEN})\s+(?:{_WHOSE})?\s*(?:us|uk|eu|un|uae|government|military|president|trump|biden|iran|israel|india|russia|china|officials?)\.$",
    r"^(?:since|after|before|amid|during|as)\s+(?:the\s+)?[a-z0-9-]+(?:\s+[a-z0-9-]+){0,4}[.!?]$",
)
CLAUSE_BREAKS = (", and ", " and ", "; ", ", while ", " while ", ", with ", ", citing ", " that ", " which ", ", ")

# Marks of doubt in a source, and of claims that rest on pictures.
UNCERTAIN = (
    "appear to show", "appears to show", "images circulating online", "online images", "circulating online", "social media", "viral images", "viral video",
    "unverified", "not independently verified", "reportedly", "alleged", "allegedly", "purportedly",
)
PICTURED = (" image ", " images ", " footage ", " video ")
PICTURE_CLAIMS = ("appear to show", "appears to show", "circulating online", "viral")
DISPROOF = ("not independently verified", "remain unconfirmed", "remains unconfirmed")

# Words that titles are compared without.
COMPARED_WITHOUT = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "this",
    "to", "was", "were", "will", "with", "after", "amid", "over", "under", "new", "latest", "says", "say",
)

# A card's title and body, in characters.
TITLE_CHARS, BODY_CHARS, TARGET_CHARS = (16, 80), (230, 360), 320
