"""Lists, patterns and limits that results depend on.

Everything here is data, not logic.  The values have to be exactly these for
results to come out the same as in the tool this engine stands in for, so they
are kept together, in plain text.
"""

# --- white space -----------------------------------------------------------
# Code points with the Unicode White_Space property, for trimming.
WHITE_SPACE = "".join(
    map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# The same set as the inside of a character class (Java and RE2 both read it).
WS = r"\s\x{0B}\x{85}\p{Z}"

# --- registry --------------------------------------------------------------
STATUSES = ["pending", "ok", "dead", "redirect", "paywall", "login"]
REGISTRY_TOOL = "ref"
EXAMPLE_URL = "https://example.com"
EXAMPLE_TITLE = "Example Reference"
EXAMPLE_CATEGORY = "example"
EXAMPLE_FILE = "README.md"

# --- URLs in text ----------------------------------------------------------
URL = rf"""https?://[^{WS})>\]"'`]+"""
URL_KEEPING_BACKTICKS = rf"""https?://[^{WS})>\]"']+"""
MARKDOWN_LINK = rf"\[([^\]]+)\]\((https?://[^{WS})]+)\)"
URL_TAIL = ",.)];:"
FACT_URL_TAIL = ",.)]"

# Host patterns of URLs that carry facts, tried in this order.
FACT_URL_PATTERNS = [
    ("instagram", rf"https?://(?:www\.)?instagram\.com/[^{WS})\]]+"),
    ("statista", rf"https?://(?:www\.)?statista\.com/[^{WS})\]]+"),
    ("market", rf"https?://(?:www\.)?(?:influencermarketinghub|emarketer|techcrunch)\.com/[^{WS})\]]+"),
]
FACT_HOSTS = [("instagram.com", "instagram"), ("statista.com", "statista")]

# (category, contained anywhere, prefix) on the lowercased path, in this order.
CATEGORY_RULES = [
    ("documentation", ["/docs/", "/doc/"], ["docs/"]),
    ("research", ["/research/"], ["research/"]),
    ("architecture", ["/adr/"], ["adr/"]),
    ("api", ["/api/"], ["api/"]),
    ("testing", ["/test"], ["test"]),
    ("readme", ["readme"], []),
    ("changelog", ["changelog"], []),
    ("legal", ["license"], []),
]
DEFAULT_CATEGORY = "general"

# --- facts in text ---------------------------------------------------------
AMOUNT = rf"\$([0-9,.]+)[{WS}]*(billion|million|B|M|K)?"
PERCENTAGE = rf"([0-9,.]+)[{WS}]*%"
FOLLOWERS = rf"([0-9,.]+[KMB]?)[{WS}]*[Ff]ollowers"
H1_TEXT = r"<h1[^>]*>([^<]+)</h1>"
TITLE_TEXT = r"<title[^>]*>([^<]+)</title>"
FACTS_PER_TEXT = 10

# --- page health -----------------------------------------------------------
# (code, phrases looked for in the lowercased page title), in this order.
TITLE_CODES = [
    (404, ["404", "not found"]),
    (403, ["403", "forbidden", "access denied"]),
    (500, ["500", "internal server error"]),
]
ERROR_CLASSES = [
    ("DNS_FAILED", ["ERR_NAME_NOT_RESOLVED"]),
    ("CONNECTION_REFUSED", ["ERR_CONNECTION_REFUSED"]),
    ("TIMEOUT", ["ERR_CONNECTION_TIMED_OUT"]),
    ("SSL_ERROR", ["ERR_CERT", "SSL"]),
]
OTHER_ERROR = "NETWORK_ERROR"

# Phrases that decide a registry entry's status.
PAYWALL_PHRASES = [
    "subscribe to continue", "subscription required", "premium content", "paywall",
    "member-only", "members only", "unlock this article", "purchase to read",
    "buy now to read", "paid subscribers",
]
LOGIN_PHRASES = [
    "sign in to continue", "log in to continue", "login to continue",
    "please sign in", "please log in", "create an account", "sign up to view",
    "register to view", "authentication required",
]
# (attribute, parts of its value); case matters here.
PAYWALL_ATTRIBUTES = [("class", ["paywall", "subscription-wall", "piano-offer", "premium-wall"]),
                      ("id", ["paywall"])]
LOGIN_ATTRIBUTES = [("class", ["login-wall", "auth-wall", "signup-wall", "gate-content"]),
                    ("id", ["login-modal"])]

# Phrases that decide the status of a structured page: shorter lists.
PAGE_PAYWALL_PHRASES = [
    "subscribe to continue", "subscription required", "premium content", "paywall",
    "member-only", "members only", "unlock this article", "purchase to read",
]
PAGE_LOGIN_PHRASES = [
    "sign in to continue", "log in to continue", "login to continue",
    "please sign in", "please log in", "create an account to", "sign up to view",
]
PAYWALL_NOTE = "Paywall detected"
LOGIN_NOTE = "Login required"
REDIRECT_NOTE = "Redirected to: "
# Ours: a table can lack a page, live fetching cannot.
NOT_CRAWLED = "Not crawled"
NO_CONTENT = "No content"

# --- structured pages ------------------------------------------------------
# Main content, by falling priority: (kind, name).
SCOPES = [
    ("tag", "main"), ("tag", "article"), ("role", "main"),
    ("class", "post-content"), ("class", "article-content"), ("class", "entry-content"),
    ("id", "content"), ("class", "content"),
]
SHORTEST_TEXT = 3
HEADING_BYTES = 200
BLANK_REACH = 50  # how far a cut goes back to a blank, in bytes
PARAGRAPH_BYTES = 2000
LINK_TEXT_BYTES = 100
SHORTEST_CODE = 10
CODE_BYTES = 5000
LINKS_PER_PAGE = 50
SECTIONS_PER_PAGE = 50
CODE_PER_PAGE = 20
FALLBACK_HEADING = "Content"
FALLBACK_WIDTH = 120
FALLBACK_LINES = 100
FALLBACK_BYTES = 10000

# --- papers ----------------------------------------------------------------
HEADING = rf"^(?:(?:\p{{Nd}}+\.?[{WS}]+)?[A-Z][A-Z{WS}]+\z|(?:Chapter|Section|Part)[{WS}]+\p{{Nd}}+)"
AUTHOR = rf"(?iu)(?:author|by|written by)[:{WS}]+([^\n]+)"
DATE = (rf"(?iu)(?:date|published|updated)[:{WS}]+"
        rf"(\p{{Nd}}{{4}}[-/]\p{{Nd}}{{2}}[-/]\p{{Nd}}{{2}}"
        rf"|[\p{{L}}\p{{M}}\p{{N}}_]+[{WS}]+\p{{Nd}}{{1,2}},?[{WS}]+\p{{Nd}}{{4}})")
DOI = rf"(?iu)(?:doi[:{WS}]+|https?://doi\.org/)(10\.\p{{Nd}}{{4,}}/[^{WS})]+)"
SECTION_OPENING_BYTES = 50
SECTION_BYTES = 10000
SECTIONS_PER_PAPER = 100
LINKS_PER_PAPER = 50
CODE_PER_PAPER = 10
LONGEST_NAME = 200
CODE_INDENTS = ["    ", "\t"]
CODE_TOKENS = ["def ", "fn ", "function ", "class ", "import ", "package ", "//", "/*", "#include"]
CODE_LANGUAGES = [  # tried in this order: all of the texts occur, or any of them
    ("rust", "all", ["fn ", "->"]),
    ("python", "all", ["def ", ":"]),
    ("javascript", "any", ["function ", "const ", "let "]),
    ("java", "any", ["public class", "private "]),
    ("c", "any", ["#include"]),
]
SHORTEST_RUN = 3
SHORTEST_ISLAND = 20
NO_FILE = "File not found"
NO_EXTRACTION = "PDF extraction failed: "
NO_TEXT = "PDF contains no extractable text"
