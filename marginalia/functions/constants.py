"""Fixed values. They must stay as they are for results to match."""

# --- chunking -------------------------------------------------------------------------
TARGET_SIZE = 700
OVERLAP = 100
MIN_CHUNK_SIZE = 100
SEPARATORS = [
    "\n# ",
    "\n## ",
    "\n### ",
    "\n#### ",
    "\n\n",
    "\n- ",
    "\n* ",
    "\n1. ",
    "\n",
    ". ",
    "? ",
    "! ",
    "; ",
    ": ",
]

# --- retrieval ------------------------------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6
LEXICAL_TOP_K = 50
VECTOR_TOP_K = 30
FUSED_TOP_K = 10
RERANK_TOP_N = 5
MAX_LINKED = 3
MIN_SIMILARITY = 0.3
RRF_K = 60
RERANK_THRESHOLD = 5.0
HALLUCINATION_THRESHOLD = 3.0
HALLUCINATION_SIMILARITY = 0.7
QUERY_SPECIAL_CHARS = "\"'()*-+:^~"

# --- dated notes ----------------------------------------------------------------------
DUE_DATE_PATTERN = r"\s*\(due:\s*(\d{4}-\d{2}-\d{2})\)\s*$"
CHECKBOX_PATTERN = r"^-\s*\[([ xX/])\]\s*(.+)$"
TIMED_EVENT_PATTERN = r"^-\s*(\d{1,2}:\d{2})\s*[—–-]\s*(.+)$"
MULTI_DAY_PATTERN = r"\(through\s+(\d{4}-\d{2}-\d{2})\)\s*$"
WIKI_LINK_PATTERN = r"\[\[([^\]|#]+)(?:[|#][^\]]+)?\]\]"
AUTO_START = "<!-- AUTO-GENERATED: Do not edit below this line -->"
AUTO_END = "<!-- END AUTO-GENERATED -->"

# --- folders --------------------------------------------------------------------------
FOLDERS = {
    "daily": "00_Daily",
    "notes": "10_Notes",
    "projects": "20_Projects",
    "concepts": "30_Concepts",
}
LIVING_DOCUMENTS = {
    "Grocery List": ("10_Notes/Grocery List.md", "replace"),
    "Recipe Ideas": ("10_Notes/Recipe Ideas.md", "append"),
}
NOTE_TYPES = ["daily_note", "note", "project", "concept", "living_document", "event"]
DEFAULT_EXCLUDES = [
    ".obsidian/*",
    ".trash/*",
    "node_modules/*",
    ".git/*",
    "*.excalidraw.md",
    "Inbox/*",
    "Tasks/All Tasks.md",
    "Tasks/Completed Tasks.md",
    "90_Meta/Templates/*",
]
DEFAULT_CATEGORIES = {
    "Work": [],
    "Personal": [
        "Family",
        "Gifts",
        "Health",
        "Errands",
        "Chores",
        "Projects",
        "General",
    ],
}

# --- usage ----------------------------------------------------------------------------
# (provider, model, input $ per million tokens, output $ per million tokens)
PRICING = [
    ("anthropic", "claude-haiku-4-5", 1.00, 5.00),
    ("anthropic", "claude-sonnet-4-5", 3.00, 15.00),
    ("openai", "gpt-4o-mini", 0.15, 0.60),
]
COST_ALERT_THRESHOLD = 1.00
STALE_AFTER_HOURS = 25
KEEP_MESSAGES = 20
EXTRACTION_MAX_CHARS = 12000

# --- words ignored when looking for recurring topics ------------------------------------
STOPWORDS = """
a about above after again against all am an and any are as at be because been before being
below between both but by can could did do does doing down during each few for from further
get got had has have having he her here hers herself him himself his how if in into is it its
itself just let like me might more most my myself no nor not now of off on once only or other
our ours ourselves out over own re same she should so some still such than that the their
theirs them themselves then there these they this those through to too under until up us very
was we were what when where which while who whom why will with would you your yours yourself
yourselves also going really think went today tomorrow yesterday need new one two three
""".split()
