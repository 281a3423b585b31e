"""Word lists and limits that results depend on. All are defaults of parameters."""

# Words that carry no topic.
STOPWORDS = (
    "the", "and", "for", "with", "from", "into", "amid", "over", "after", "before", "under", "near",
    "this", "that", "their", "your", "will", "have", "has", "been", "about", "what", "when", "where",
    "which", "today", "live", "update", "updates", "latest", "video", "photos", "photo", "watch", "report",
    "reports", "news", "story", "stories", "says", "said", "say", "here", "why", "new", "still", "just",
    "more", "than", "until", "till", "continue", "continues", "continuing",
)

# Words of any news item.
GENERIC = (
    "official", "officials", "minister", "president", "government", "leader", "leaders", "country",
    "countries", "people", "person", "issue", "issues", "move", "moves", "plan", "plans", "meeting",
    "talk", "talks", "warning", "warn", "warns", "threat", "threats", "major", "fresh",
)

# Words that are left out of story keys.
KEY_GENERIC = (
    "name", "names", "named", "next", "ceo", "chief", "executive", "prepare", "prepares",
    "step", "steps", "down", "successor", "appoint", "appoints", "appointed",
)

# Words that stand for others.
SYNONYMS = {
    "attacks": "strike", "attack": "strike", "airstrikes": "strike", "airstrike": "strike", "strikes": "strike", "strike": "strike",
    "postpones": "delay", "postponed": "delay", "postpone": "delay", "delays": "delay", "delayed": "delay",
    "threatened": "threat", "threatens": "threat", "threatening": "threat",
    "iranian": "iran", "israeli": "israel", "lebanese": "lebanon", "american": "us",
}

# Keywords of each category.
CATEGORY_KEYWORDS = {
    "business": ("economy", "market", "stock", "business", "company", "trade", "finance", "inflation", "gdp", "investor", "earnings", "revenue", "ipo", "fund", "bank", "rupee", "dollar", "shares"),
    "tech": ("technology", "tech", "ai", "artificial intelligence", "software", "chip", "startup", "internet", "cyber", "semiconductor", "algorithm", "digital", "platform", "machine learning", "copyright", "creative rights"),
    "international": ("war", "conflict", "diplomatic", "sanction", "missile", "border", "ceasefire", "united nations", "nato"),
    "national": ("india", "indian", "new delhi", "ministry", "government of india"),
    "politics": (
        "election", "elections", "parliament", "lok sabha", "rajya sabha", "minister", "cabinet", "modi", "rahul gandhi", "amit shah", "congress", "bjp", "aap", "opposition", "coalition", "governor",
        "chief minister", "assembly", "vote", "poll", "polls", "constituency", "campaign", "manifesto", "alliance", "party", "leader", "speaker", "bypoll", "ec", "election commission",
    ),
    "sports": ("sport", "sports", "match", "tournament", "league", "cup", "goal", "coach", "player", "cricket", "football", "tennis"),
}

# Parts of source addresses that hint at a category.
SOURCE_HINTS = {
    "business": ("/business", "markets", "economy", "finance", "/markets", "moneycontrol"),
    "tech": ("/technology", "/tech", "science"),
    "international": ("/world", "world-news", "international", "middle-east", "europe", "asia", "africa"),
    "national": ("/india", "/news/national", "nation"),
    "politics": ("/politics", "political-pulse", "/elections", "/election", "lok-sabha", "rajya-sabha"),
    "sports": ("/sport", "/sports", "cricket", "football", "tennis", "olympic"),
}

# Places that mark a text as Indian.
INDIA_MARKERS = (
    "india", "indian", "new delhi", "delhi", "mumbai", "bengaluru", "kolkata", "hyderabad", "chennai",
    "rajya sabha", "lok sabha", "bihar", "telangana", "andhra pradesh", "west bengal", "maharashtra", "karnataka",
)

# Words that mark a text as international.
INTERNATIONAL_MARKERS = (
    "war", "conflict", "missile", "uav", "airstrike", "air strike", "drone", "missiles", "nato", "united nations",
    "middle east", "iran", "russia", "israel", "ukraine", "china", "afghanistan", "pakistan", "asia", "europe", "uk", "england", "britain", "london", "norfolk",
    "africa", "diplomatic", "embassy", "foreign", "global", "international", "summit", "g20", "tariff", "attack",
    "bombing", "explosion", "fleet", "navy", "air force",
)

# Local politics, international and Indian sources.
LOCAL_POLITICS = ("rajya sabha", "lok sabha", "chief minister", "cabinet", "parliament", "state", "assembly", "election", "governor")
INTERNATIONAL_SOURCES = ("bbc", "reuters", "aljazeera", "cnn", "ap", "reuterswire")
INDIA_SOURCES = ("toi", "times of india", "ndtv", "india today", "the hindu")

# Politics keywords of which one is enough.
POLITICS_STRONG = (
    "election", "elections", "parliament", "lok sabha", "rajya sabha", "cabinet", "modi", "rahul gandhi", "amit shah",
    "bjp", "congress", "opposition", "chief minister", "assembly", "vote", "poll", "election commission",
)

# Limits and phrases of the content gate.
MIN_TITLE_CHARS, MIN_BODY_CHARS = 16, 120
IRRELEVANT = ("advertisement", "subscribe to", "follow us on", "click here", "read more")
LOW_VALUE_URLS = ("/authors/", "/author/", "/opinion/", "/opinions/", "/education/", "/live-updates/", "/live-blog/", "/liveblog/")
LOW_VALUE_TITLES = (
    "opinion |", "live:", "live updates", "how to download", "when and how to", "check official websites", "view result",
    "result to be out", "trailer", "box office", "dating", "relationship", "wife", "husband", "girlfriend", "boyfriend",
)

# How far sources are trusted; others get the default.
DEFAULT_CREDIBILITY = 0.4

# The plan, in order: category, items, breaking items.
PLAN = (("international", 5, 3), ("national", 5, 3), ("politics", 5, 3), ("business", 5, 3), ("tech", 5, 3), ("sports", 5, 0))
CREDIBILITY = {"BBC": 0.9, "AlJazeera": 0.82, "TOI": 0.78, "NDTV": 0.72, "India Today": 0.79, "Reuters": 0.95, "The Hindu": 0.84}

# Words that titles are compared without.
TITLE_STOPWORDS = (
    "the", "and", "with", "from", "into", "amid", "over", "after", "near", "their", "this", "that", "will",
    "have", "has", "been", "about", "under", "into", "more", "than", "what", "when", "where", "which", "india",
)

# Endings that titles are stemmed by, in order, with what replaces them.
STEM_SUFFIXES = (
    ("ies", "y"), ("ves", "f"), ("ses", "s"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("zes", "z"), ("ness", ""),
    ("ment", ""), ("ing", ""), ("tion", ""), ("ed", ""), ("er", ""), ("ly", ""), ("es", ""), ("s", ""),
)

# Keywords that give an item priority.
PRIORITY_KEYWORDS = {
    "international": (
        "us", "usa", "white house", "narendra modi", "donald trump", "elon musk", "bill gates", "satya nadella", "sundar pichai", "obama", "rishi sunak", "dubai", "saudi", "gulf", "gcc",
        "singapore", "thailand", "russia", "eu", "nato", "un", "brics", "g7", "israel", "jai shankar", "jaishankar", "oscars",
    ),
    "national": (
        "narendra modi", "modi", "pm modi", "amit shah", "nithin gadkari", "arvind kejriwal", "rajnath", "minister", "cabinet", "parliament", "speaker", "lop", "rajyasabha", "rajya sabha",
        "supreme court", "cec", "ec", "election commission", "bollywood", "rahul gandhi", "kharge", "sonia gandhi", "bjp", "congress", "aap", "shiv sena", "rjd", "rss", "brs", "tdp", "ysrcp",
        "dmk", "aiadmk", "chandra babu", "naidu", "jagan", "vijay", "stalin", "mgr",
    ),
    "sports": (
        "cricket", "football", "tennis", "world cup", "ipl", "f1", "champions league", "fifa", "olympics", "wimbeldon", "wimbledon", "gambhir", "dhoni", "virat", "hardik", "suryakumar",
        "rohit", "bumrah", "gill", "sachin", "india", "pakistan", "england", "australia", "south africa", "new zealand",
    ),
    "technology": ("apple", "samsung", "xiaomi", "oppo", "vivo", "one plus", "nothing", "amazon", "flipkart", "myntra", "ajio", "whatsapp", "ai", "google"),
    "business": (
        "nasa", "isro", "rbi", "cag", "nifty", "sensex", "bse", "nse", "results", "startup", "real estate", "banks", "gold", "silver", "pe", "vc", "fund", "ambani", "reliance",
        "adani", "mittal", "birla",
    ),
    "general": (
        "bollywood", "tollywood", "tamil", "kannada", "hollywood", "netflix", "amazon", "jio", "sony", "oscar", "filmfare", "review", "rating", "controversy", "trailer", "date", "exercise",
        "fitness", "tips", "obesity", "brain", "adulteration", "hospitals", "diagnostics", "preventive",
    ),
}

# Limits of a card that can be published, and the categories it may have.
CARD_TITLE, CARD_BODY = (10, 80), (50, 380)
CARD_BOILERPLATE = (r"\b(?:the\s+times\s+of\s+india|times\s+of\s+india|india\s+today|bbc\s+news|al\s*jazeera)\b", r"\bof\s+india\.\s+of\s+india\b")
