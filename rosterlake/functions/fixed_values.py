"""Word lists, tokens and patterns that results depend on.

Everything here is data. Patterns are written for Java regular expressions;
``SPACE`` and ``WORD`` spell out the Unicode whitespace and word characters the
rules are defined over (Java's bare ``\\s`` and ``\\w`` are ASCII only).
"""

# --- character classes ------------------------------------------------------

# All characters that count as whitespace.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"\t\n\x0b\f\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029]"

# --- input tables -----------------------------------------------------------

NULL_TOKENS = ("", "none", "null", "nan")
PENDING_STATUSES = ("", "none", "null", "nan", "skipped")

# --- page cleaning ----------------------------------------------------------

NOISE_ELEMENTS = ("script", "style", "svg", "noscript", "head", "meta", "link", "iframe")
NOISE_TAGS = ("meta", "link", "input", "br", "hr", "img")
KEPT_ATTRIBUTES = (
    "href", "class", "id", "src", "alt", "title", "name", "type", "value", "target",
)

# --- page classification ----------------------------------------------------

TEMPLATE_MARKERS = (
    "{{", "v-bind", "v-if", "v-for", "v-model",
    "ng-app", "ng-controller", "ng-repeat",
    "__vue__", "__vue_app__", "_reactRootContainer",
    "data-reactroot", "data-reactid",
    '<div id="root">', '<div id="app">',
)
DATA_API_MARKERS = (
    "/api/", "fetch(", "ajax(", "xmlhttp", "staff_data", "faculty_data",
    "person_data", "load_people", "get_people", "member_data",
)
STAFF_WORDS = (
    "professor", "associate", "lecturer", "faculty",
    "academic staff", "teaching staff", "staff directory",
)
TEMPLATE_MIN_CHARS = 15_000
TEMPLATE_MIN_EMAILS = 3
BLOCKED_MIN_CHARS = 1_000
BLOCKED_HEAD_PATTERN = r"(?i)403|forbidden|just a moment"
BLOCKED_TITLE_TEXTS = ("403", "Forbidden", "Just a moment")
BLOCKED_MARKER = "cf-browser-verification"
#: Pages of up to so many words say no more than why they were refused.
BLOCKED_MAX_WORDS = 60
#: Elements whose text shows code instead of running it.
CODE_ELEMENTS = ("pre", "code", "textarea")
SCRIPT_ELEMENTS = ("script", "style")
CONTENT_MIN_CHARS = 200
ACCEPT_MIN_CHARS = 5_000

EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
URL_PATTERN = rf"https?://[^{SPACE}]+"
CJK_PATTERN = r"[\u4e00-\u9fff\u3400-\u4dbf]"

# --- page comparison --------------------------------------------------------
# (needle, pattern, replacement), applied in this order; ``ignore_mailto=False``
# leaves the last one out. The needle is a text that every match holds: pages
# without it are not searched. Patterns start with their literal, so that the
# engine skips to it; the look-behind tests the character before it.

VOLATILE_REWRITES = (
    ("id=", rf'id=(?<![{WORD}]id=)(?:"|&quot;)[^"&]*(?:"|&quot;)', ""),
    ("for=", rf'for=(?<![{WORD}]for=)(?:"|&quot;)[^"&]*(?:"|&quot;)', ""),
    ("class=", rf'class=(?<![{WORD}]class=)(?:"|&quot;)[^"&]*(?:"|&quot;)', ""),
    ('name="', rf'name="(?<![{WORD}]name=")[0-9a-f]{{32}}"', 'name=""'),
    ("<script", rf"(?s)<script(?![{WORD}]).*?</script>", ""),
    ('nonce="', rf'nonce="(?<![{WORD}]nonce=")[^"]*"', ""),
    ("_csrf", rf'_csrf(?<![{WORD}]_csrf)[^=]*="[^"]*"', ""),
    ('"csrf.token":', rf'"csrf\.token":[{SPACE}]*"[^"]*"', ""),
    ("<meta", rf"<meta(?![{WORD}])[^>]*>", ""),
    ("data-", rf'data-[{WORD}-]+="[^"]*"', ""),
    ('href="', r'href="([^"]*)\?[^"]*"', 'href="$1"'),
    (".css?", rf'\.css\?(?<=[^{SPACE}"<>?]\.css\?)[^{SPACE}"<>]*', ".css"),
    ("_wpnonce", r"_wpnonce[a-zA-Z0-9_]*", "_wpnonce"),
    (".js?", rf'\.js\?(?<=[^{SPACE}"<>?]\.js\?)[^{SPACE}"<>]*', ".js"),
    ("?", rf'(https?://[^{SPACE}"<>?]*)\?[^{SPACE}"<>]*', "$1"),
    ("-", r"-\p{Nd}{10,}", "-0"),
    ("mailto:", rf'<a[{SPACE}][^>]*href="mailto:[^"]*"[^>]*>[^\n]*?</a>', ""),
)

# --- URLs -------------------------------------------------------------------

BLOCKED_HOSTS = (
    "linkedin.com", "facebook.com", "wikipedia.org", "youtube.com",
    "twitter.com", "x.com", "instagram.com", "reddit.com", "glassdoor.com",
    "indeed.com", "topuniversities.com", "usnews.com", "timeshighereducation.com",
)
DISCOVERY_BLOCKED_HOSTS = ("wikipedia", "linkedin", "facebook")
LISTING_PATHS = ("/people", "/staff", "/faculty", "/academic-staff")

# --- people and departments -------------------------------------------------

TITLE_PREFIX_PATTERN = r"(?:Prof\.|Dr\.|Professor)"
HONORIFIC_PATTERN = r"^(Prof\.|Dr\.|Mr\.|Ms\.|Professor)"
ROLE_INCLUDE = (
    "professor", "lecturer", "head of department", "department head", "dean", "director",
)
ROLE_EXCLUDE = (
    "postdoc", "research fellow", "research assistant", "research staff",
    "scientific staff", "teaching support", "teaching assistant", "technician",
    "administrative", "secretary", "it support", "hr", "finance",
    "phd student", "graduate student", "intern",
)
DEPARTMENT_EXCLUDE = (
    "hr", "human resources", "finance", "it", "library", "registrar",
    "centre", "center", "lab", "laboratory",
    "graduate school", "continuing education", "professional studies",
)

# --- messages and statuses written into results ------------------------------

REMARK_BLOCKED = "Detail page unreachable: "
REMARK_FAILED = "LLM extraction failed for: "
STATUS_COMPLETED = "completed"
STATUS_SKIPPED = "Skipped"
STATUS_URL_FOUND = "url-found"
STATUS_FAILED_PREFIX = "failed: "
PAGE_ISSUE_PREFIX = "Listing page issue: "
NO_PAGE_ERROR = "No page HTML available for scraping."

# --- limits that are part of the rules --------------------------------------

ERROR_BUDGET = 5
EXPIRY_SECONDS = 30 * 24 * 3600
SEARCH_HITS_DISCOVERY = 5
QUERIES_WITH_DEPARTMENT = (
    "{u} {d} faculty", "{u} {d} academic staff", "{u} department of {d} faculty",
    "{u} {d} staff", "{u} {d} professors",
)
QUERIES_WITHOUT_DEPARTMENT = (
    "{u} faculty", "{u} academic staff", "{u} staff", "{u} professors",
)
