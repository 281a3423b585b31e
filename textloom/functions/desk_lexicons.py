"""Fixed values of the desk, sentence, link and image rules: lists that results depend on. All are defaults of parameters."""

# The desks that a card may be filed under, and what a run's category and older labels stand for.
DESKS = ("Assembly Elections", "Technology", "Lifestyle", "State", "International", "National", "Entertainment", "Finance", "Sports")
HINT_DESKS = {"business": "Finance", "tech": "Technology", "international": "International", "national": "National", "politics": "National", "sports": "Sports"}
OLD_LABELS = {
    "business": "Finance", "politics": "National", "crime": "National", "health": "Lifestyle", "education": "National",
    "environment": "Lifestyle", "spiritual": "Lifestyle", "telangana": "State", "andhra pradesh": "State", "tech": "Technology",
}

# Sources of India and of the world.
INDIA_SOURCES = (
    "toi", "the hindu", "times of india", "ndtv", "india today", "hindustan times", "indian express",
    "new indian express", "telangana today", "siasat", "eenadu",
)
GLOBAL_SOURCES = ("guardian", "bbc", "reuters", "aljazeera", "al jazeera", "cnn", "associated press", "ap")

# Keywords of each desk.
ELECTION = (
    "assembly election", "assembly polls", "assembly elections", "lok sabha election", "general election",
    "by-election", "bypoll", "by-poll", "vote count", "counting of votes", "exit poll", "election commission",
    "poll campaign", "election rally", "voter turnout", "constituency", "candidate list", "manifesto",
    "nomination filed", "ballot",
)
ENTERTAINMENT = (
    "movie", "film", "box office", "trailer", "teaser", "actor", "actress", "bollywood", "tollywood",
    "hollywood", "ott", "web series", "song", "album", "celebrity", "cinema", "director", "release date",
)
LIFESTYLE = (
    "health", "wellness", "fitness", "diet", "recipe", "food", "travel", "tourism", "fashion", "beauty",
    "lifestyle", "yoga", "mental health", "skincare", "relationship", "parenting",
)
TECH = (
    "technology", "tech", "artificial intelligence", "ai", "software", "chip", "semiconductor", "cyber", "internet",
    "platform", "algorithm", "openai", "model", "machine learning", "copyright", "creative rights", "digital",
)
BUSINESS = (
    "market", "stock", "economy", "inflation", "company", "startup", "gdp", "trade", "business", "finance",
    "interest rate", "mortgage", "bank", "oil prices", "revenue",
)
STATE = (
    "telangana", "hyderabad", "secunderabad", "warangal", "khammam", "nizamabad", "karimnagar", "ktr", "revanth reddy",
    "ghmc", "huzurabad",
    "andhra pradesh", "amaravati", "visakhapatnam", "vijayawada", "tirupati", "guntur", "kadapa", "nellore",
    "ananthapur", "ananthapuramu", "chandrababu", "jagan",
)
SPORTS_PARTS = (
    "cricket", "football", "soccer", "tennis", "badminton", "hockey", "olympic", "world cup", "tournament", "match", "coach", "player", "goal",
)
INDIA_PARTS = (
    " india ", " indian ", "new delhi", "delhi", "mumbai", "bengaluru", "kolkata", "chennai", "hyderabad",
    "times of india", "the hindu", "rajya sabha", "lok sabha", "bihar", "telangana", "andhra pradesh",
    "west bengal", "maharashtra", "uttar pradesh", "tamil nadu", "kerala", "karnataka", "gujarat",
)

# What the final decision looks for.
FINAL_INDIA_SOURCES = ("toi", "times of india", "the hindu", "ndtv", "india today", "hindustan times", "indian express")
FINAL_INDIA_PARTS = (
    " india ", " indian ", "new delhi", "delhi", "mumbai", "bengaluru", "kolkata", "chennai",
    "hyderabad", "rajya sabha", "lok sabha", "andhra pradesh", "telangana",
)
FINAL_STATE_PARTS = (
    "telangana", "hyderabad", "secunderabad", "warangal", "khammam", "nizamabad",
    "andhra pradesh", "amaravati", "visakhapatnam", "vijayawada", "tirupati", "guntur",
)
FINAL_TECH_PARTS = (
    "technology", " tech ", "artificial intelligence", " ai ", "software", "algorithm", "chip",
    "semiconductor", "digital", "cyber", "creative rights", "copyright",
)
WORLD_SECTIONS = ("/world", "/middle-east/", "/rest-of-world/", "/us/", "/europe/", "/asia/", "/africa/")

# Titles that are no news.
SOFT_PARTS = ("holiday", "free entry", "best timings", "miracle garden", "shock you", "will shock you", "in photos", "watch:", "offers free", "how to", "review")
SOFT_ABROAD = ("eid", "tourist", "garden", "weekend", "break confirmed")

# What follows the prose of an article; each goes with all behind it, in this order.
TAILS = (
    r"\s*-\s*Ends\b.*$", r"\bPublished\s+By\s*:\s*.{0,60}$", r"\bPublished\s+On\s*:\s*.{0,40}$", r"\bAlso\s+Read\s*[|:].+$",
    r"\bStory\s+continues\s+below\s+this\s+ad\b.*$", r"\bAdvertisement\b.*$", r"\bRead\s+more\s+at\s+TOI\b.*$", r"\bFORTHCOMING\s+STORIES\b.*$",
    r"\bSubscribe\s+to\s+India\s+Today\b.*$", r"\bGet\s+latest\s+news\s+on\b.*$", r"(?:Watch|Follow)\s+(?:live|us\s+on)\b.*$",
)

# Markup and scripts within a text, with the flags of each.
SCRIPTS = (
    r"(?is)<script[^>]*>.*?</script>", r"<[^>]+>", r"(?s)\(function\s*\([^)]*\)\s*\{.*?\}\s*\)\s*\([^;]*\)\s*;?",
    r"\b\w+\.(?:createElement|appendChild|getElementById|setAttribute)\b[^.;]*[.;]?", r"(?:window|document|d\.head|v\.location)\.\w+[^.;]*[.;]?",
    r"""["']?//[\w.\-]+\.(?:ai|com|net|io)/[\w./\-]*\.js["']?""",
)

# Sentences of no use.
LOW_VALUE_SENTENCES = (
    r"\bis a vital waterway\b", r"\bis a key waterway\b", r"\bis a vital maritime route\b", r"\bis a major maritime route\b",
    r"^(?:it is now under scrutiny again)\b", r"^(?:this (?:development|situation|scrutiny)|the move)\s+(?:could|may|might)\s+(?:impact|affect|signal)\b",
    r"\bunder close watch in the coming days\b", r"\baffecting regional dynamics\b",
)

# The closing sentence by topic, first match wins.
CONTEXT_TAILS = (
    (("hormuz",), "The move keeps pressure on Iran over reopening the Strait of Hormuz."),
    (("gold", "bullion", "silver", "market volatility"), "The sharp move kept attention on how global volatility is feeding into local bullion prices."),
    (("court", "judge", "ruling", "case"), "The ruling is likely to keep the case under close watch in the coming days."),
    (("deportees", "deportation", "third-country"), "The deal adds to Washington's options for third-country deportations."),
    (("ipl", "bcci", "t20"), "The announcement sets the stage for the new season later this month."),
    (("troops", "lebanon", "sovereignty", "invasion"), "The warning adds to pressure over the widening ground operation in the region."),
)
CONTEXT_OTHERWISE = "The development is likely to keep the issue under close watch in the coming days."

# Words that style tokens and image queries leave out.
STYLE_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "into",
    "is", "it", "its", "of", "on", "or", "that", "the", "their", "this", "to", "was", "were", "will", "with",
)
PICTURE_WORDS = ("photo", "photos", "image", "images", "video", "report", "reports", "story")
TOPIC_STOPWORDS = (
    "the", "and", "with", "from", "this", "that", "into", "after", "over", "under",
    "amid", "what", "when", "where", "which", "who", "will", "have", "has", "been",
    "about", "into", "against", "their", "its", "than", "news",
)

# Markers of doubt and of proof in a text.
CAUTION = ("appear to show", "appears to show", "reportedly", "alleged", "allegedly", "unverified", "not independently verified", "purportedly")
PROOF = ("bbc verify", "verified by", "investigation confirms", "verified images", "confirmed by officials", "confirmed by the military", "confirmed through flight radar")

# Addresses of pictures that aren't taken.
BLOCKED_PARTS = (
    "watermark", "logo", "branding", "badge", "channelbug", "sprite", "overlay-toi_sw", "branded_news", "grey-placeholder", "bbcdotcom",
    "1x1_spacer", "androidtv-app", "default-690x413", "screenshot_", "/reporter/", "/_next/image", "ai-generated-image",
    "representational-purpose", "used-only-for-representational-purpose", "static.files.bbci.co.uk",
)
BLOCKED_HOSTS = ("scorecardresearch.com",)
BLOCKED_KEYS = ("overlay", "overlay-base64", "watermark", "logo", "branding", "credit")
BLOCKED_VALUES = ("toi_sw", "overlay", "watermark", "logo", "branding", "credit")
BLOCKED_SIZE = r"(?:^|[?&,/])(?:w|width|h|height)=?(?:9[0-9]|1[0-9]{2})(?:[,&]|$)"

# Why a picture is refused, most telling first, and what its place adds to its score.
REASONS = (
    "overlay_or_branding_url_rejected", "resolution_too_low", "unknown_dimensions", "blur_detected", "low_relevance",
    "file_too_small", "download_failed", "non_image_content", "extreme_aspect_ratio",
)
PLACE_BONUS = {"og:image": 0.08, "twitter:image": 0.06, "schema": 0.05, "srcset": 0.06, "body": 0.09, "fallback": 0.04}

# Shortest title and body by source, and whether a preview picture is needed.
LEAST = {
    "BBC": (16, 60, False), "AlJazeera": (16, 60, False), "TOI": (20, 80, False), "NDTV": (18, 80, False),
    "India Today": (18, 80, False), "Reuters": (20, 100, True), "Guardian": (20, 100, True), "The Hindu": (20, 100, False),
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Words around pictures that show no news.
UNWANTED = (
    "logo", "icon", "avatar", "author", "profile", "placeholder", "spacer", "sprite", "branding", "badge", "credit", "reporter", "screenshot", "promo",
)
