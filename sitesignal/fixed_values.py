"""Word lists, patterns and limits that decide results.

Every value here is a constant of the data model and must stay as it is for
results to agree with earlier runs. Operators take them as default arguments,
so a job can pass its own lists instead.
"""

# ---- Limits -----------------------------------------------------------------

MAX_SITEMAP_DEPTH = 3
MAX_SITEMAP_FILES_PER_SITE = 50
MAX_SITEMAP_PAGES_PER_SITE = 20000
MAX_PAGES_PER_SITE = 20
MAX_SECOND_HOP_LINKS = 8
MAX_SECOND_HOP_SEGMENTS = 2
MAX_SOFT_MATCH_SEGMENTS = 2
WAVE_SIZE = 6
MIN_PAGES_BEFORE_STOP = 3
GIVE_UP_SECONDS = 180
FETCH_ATTEMPTS = 3
RETRYABLE_STATUSES = [429, 500, 502, 503, 504]
MAX_RETRY_AFTER_SECONDS = 15.0
MAX_BACKOFF_SECONDS = 10.0
DEFAULT_MIN_INTERVAL_SECONDS = 0.5
HISTORY_LIMIT = 20
RECENT_ROWS = 40

# ---- Sitemap locations tried when robots.txt declares none --------------------

COMMON_SITEMAP_PATHS = [
    "/sitemap.xml",
    "/sitemap_index.xml",
    "/sitemap-index.xml",
    "/wp-sitemap.xml",
    "/sitemap.xml.gz",
    "/sitemap/sitemap.xml",
    "/sitemaps.xml",
]

# ---- Contact-page words --------------------------------------------------------

CONTACT_KEYWORDS = [
    # English
    "contact", "contact-us", "contactus", "about", "about-us", "aboutus",
    "support", "help", "get-in-touch", "getintouch", "reach-us", "reach-out",
    "connect", "enquiry", "inquiry", "customer-service", "customer-support",
    # Spanish
    "contacto", "contactenos", "contactanos", "sobre-nosotros", "quienes-somos", "soporte", "ayuda",
    # French
    "contactez-nous", "nous-contacter", "a-propos", "apropos", "assistance",
    # German
    "kontakt", "kontaktiere-uns", "ueber-uns", "uber-uns", "hilfe",
    # Italian
    "contatti", "chi-siamo", "assistenza",
    # Portuguese
    "contato", "fale-conosco", "sobre-nos", "suporte",
    # Dutch
    "neem-contact-op", "over-ons",
]

HARD_CONTACT_KEYWORDS = [
    # English
    "contact", "contact-us", "contactus", "about-us", "aboutus",
    "get-in-touch", "getintouch", "reach-us", "reach-out", "customer-service", "customer-support",
    # Spanish
    "contacto", "contactenos", "contactanos", "sobre-nosotros", "quienes-somos",
    # French
    "contactez-nous", "nous-contacter", "a-propos", "apropos",
    # German
    "kontakt", "kontaktiere-uns", "ueber-uns", "uber-uns",
    # Italian
    "contatti", "chi-siamo",
    # Portuguese
    "contato", "fale-conosco", "sobre-nos",
    # Dutch
    "neem-contact-op", "over-ons",
]

PRIMARY_CONTACT_KEYWORDS = [
    # English
    "contact", "contact-us", "contactus", "get-in-touch", "getintouch",
    "reach-us", "reach-out", "customer-service", "customer-support",
    # Spanish
    "contacto", "contactenos", "contactanos",
    # French
    "contactez-nous", "nous-contacter",
    # German
    "kontakt", "kontaktiere-uns",
    # Italian
    "contatti",
    # Portuguese
    "contato", "fale-conosco",
    # Dutch
    "neem-contact-op",
]

NEGATIVE_PATH_WORDS = [
    "policy", "privacy", "terms", "legal", "license", "gdpr", "cookie", "cookies",
    "blog", "weblog", "news", "press", "article", "articles",
]

DATED_PATH_PATTERN = r"(?i)/\d{4}/(?:\d{1,2}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)/"

# ---- Address validity ------------------------------------------------------------

BLOCKED_DOMAINS = [
    # reserved names and common placeholders
    "example.com", "example.org", "example.net",
    "sentry.io", "sentry-next.wixpress.com", "wixpress.com",
    "godaddy.com", "domain.com", "yourdomain.com", "yoursite.com", "yourbusiness.com",
    "schema.org", "w3.org", "adobe.com",
    "acme.com", "acmeinc.com", "company.com", "hostname.com", "encom.com",
    "foo.com", "bar.com", "test.com", "placeholder.com", "notarealemail.com",
    "noemail.com", "yourcompany.com", "mycompany.com", "email.com", "website.com",
    "host.com", "doe.net", "doe.com", "xyzcorp.com", "mail.com", "email.de",
    "lovelace.app", "lovelace.com",
    "ihrefirma.com", "tuempresa.com", "suaempresa.com",
    # disposable mailboxes
    "mailinator.com", "guerrillamail.com", "10minutemail.com", "temp-mail.org",
    "tempmail.com", "throwawaymail.com", "mailnesia.com", "trashmail.com",
    "fakeinbox.com", "dispostable.com", "yopmail.com", "sharklasers.com",
    "getnada.com", "maildrop.cc",
    # image names
    "2x.png", "1x.png",
]

BLOCKED_LOCAL_PARTS = [
    "no-reply", "noreply", "donotreply", "test", "example",
    "youremail", "email", "yourname",
    "john.appleseed", "jane.appleseed", "john.doe", "jane.doe",
    "beispiel",
]

ASSET_SUFFIXES = [
    "png", "jpg", "jpeg", "gif", "svg", "webp",
    "mjs", "js", "css", "map", "json", "wasm",
]

ESCAPED_LOCAL_PART_PATTERN = r"(?i)^u[0-9a-f]{4}$"
RETINA_SUFFIX_PATTERN = r"(?i)@\d+x\.[a-z]{1,5}$"

# ---- Signals in text and markup -----------------------------------------------------

EMAIL_PATTERN = (
    r"[a-zA-Z0-9][a-zA-Z0-9._%+\-]{0,63}@[a-zA-Z0-9][a-zA-Z0-9.\-]{0,253}\.[a-zA-Z]{2,24}"
)

# "name [at] host [dot] tld", brackets and blanks optional, with an optional
# second label for endings such as co.uk
OBFUSCATED_EMAIL_PATTERN = (
    r"(?U)([a-zA-Z0-9._%+\-]{1,64})\s*[\[\(]?\s*(?:at|AT|@)\s*[\]\)]?\s*"
    r"([a-zA-Z0-9.\-]{1,253})\s*[\[\(]?\s*(?:dot|DOT)\s*[\]\)]?\s*"
    r"([a-zA-Z]{2,24})"
    r"(?:\s*[\[\(]?\s*(?:dot|DOT)\s*[\]\)]?\s*([a-zA-Z]{2,24}))?"
)

PROTECTED_ATTRIBUTE_PATTERN = r'data-cfemail="([a-fA-F0-9]+)"'
PROTECTED_LINK_PATTERN = r"/cdn-cgi/l/email-protection#([a-fA-F0-9]+)"

TEL_LINK_PATTERN = r"""(?i)href=["']tel:([^"']+)["']"""
INTERNATIONAL_PHONE_PATTERN = (
    r"(?U)(?=\+)(?<![\w/.])\+\d{1,3}[\s.\-]?\(?\d{1,4}\)?(?:[\s.\-]?\d{2,4}){2,4}(?![\d])"
)

WHATSAPP_PATTERN = (
    r"""(?i)https?://(?:api\.|web\.)?(?:wa\.me/[\d+]+|whatsapp\.com/send\?[^\s"'<>]*)"""
)

SHARE_LINK_PATTERN = r"(?i)(?:sharer|share\.php|intent/tweet|/tr\?|dialog/share|share_button)"
SOCIAL_PROFILE_PATTERNS = [
    r"""(?i)^https?://(?:www\.)?facebook\.com/[A-Za-z0-9_.\-]+/?(?:\?[^"'<>\s]*)?$""",
    r"""(?i)^https?://(?:www\.)?instagram\.com/[A-Za-z0-9_.\-]+/?(?:\?[^"'<>\s]*)?$""",
    r"""(?i)^https?://(?:www\.)?linkedin\.com/(?:company|in)/[A-Za-z0-9_.\-]+/?(?:\?[^"'<>\s]*)?$""",
    r"""(?i)^https?://(?:www\.)?(?:twitter|x)\.com/[A-Za-z0-9_]+/?(?:\?[^"'<>\s]*)?$""",
]

# vendor, then rules; a rule holds when all of its markers occur in the page
BLOCK_SIGNATURES = [
    ("cloudflare", [
        ["cf-browser-verification"],
        ["cdn-cgi/challenge-platform"],
        ["attention required! | cloudflare"],
    ]),
    ("akamai", [
        ["akamaighost"],
        ["access denied", "reference #"],
    ]),
    ("perimeterx", [
        ["px-captcha"],
        ["_pxcaptcha"],
        ["please verify you are a human", "perimeterx"],
    ]),
]

FORM_MARKER_PATTERN = (
    r"(?i)wpcf7-form|gform_wrapper|hs-form|freshworks_button|formspree|netlify-form|"
    r"contact-form|contactform|contact_form"
)

DATA_SCRIPT_TYPE_PATTERN = r"^application/(ld\+)?json$"
DATA_SCRIPT_ID_PATTERN = r"__NEXT_DATA__|__NUXT_DATA__|__remix"

# ---- Roles, best first -----------------------------------------------------------------

ROLE_KEYWORDS = [
    ("general", [
        "info", "hello", "hi", "hey", "contact", "contactus", "hola",
        "enquiries", "enquiry", "inquiries", "inquiry", "mail", "office",
        "general", "ask", "team", "reception", "admin",
    ]),
    ("sales", [
        "sales", "business", "bizdev", "biz", "partnerships", "partner",
        "partners", "deals", "newbusiness", "reseller",
    ]),
    ("support", [
        "support", "help", "helpdesk", "care", "customercare",
        "customerservice", "service", "success", "customersuccess", "feedback",
    ]),
    ("press", [
        "press", "media", "pr", "news", "communications", "comms", "publicity", "marketing",
    ]),
    ("careers", [
        "careers", "career", "jobs", "job", "hr", "recruiting",
        "recruitment", "talent", "hiring", "work", "people", "apply",
    ]),
    ("billing", [
        "billing", "accounts", "accounting", "finance", "invoices",
        "invoice", "payments", "payment", "orders",
    ]),
    ("legal", [
        "legal", "privacy", "dpo", "gdpr", "compliance", "abuse",
        "security", "trust", "copyright", "dmca", "fraud", "coc", "conduct",
    ]),
]

ROLE_ORDER = [
    "general", "sales", "support", "personal", "press", "careers", "billing", "legal", "other",
]

SYSTEM_LOCAL_PARTS = [
    "webmaster", "postmaster", "hostmaster", "newsletter", "newsletters",
    "notifications", "notification", "mailer", "daemon", "bounce", "bounces",
    "root", "administrator", "automated", "system", "do-not-reply",
    "unsubscribe", "confirm", "verify", "verification", "activate",
    "activation", "signup", "register", "registration", "optout",
    "subscribe", "confirmation",
]

# ---- Output -----------------------------------------------------------------------------

RESULT_COLUMNS = [
    "input_url", "domain", "primary_email", "primary_role",
    "own_domain_emails", "other_domain_emails",
    "phone", "whatsapp", "social_links",
    "method", "source_pages", "error", "blocked_by",
    "has_contact_form", "page_title", "meta_description", "og_title", "og_description",
]

CATEGORIES = [
    "email_found", "connection_failed", "salvage_only",
    "genuine_no_result", "permanently_blocked", "has_contact_form",
]

ERROR_UNPARSEABLE = "could not parse domain"
ERROR_UNREACHABLE = "domain unreachable (fast-fail connectivity probe)"
ERROR_NO_PAGES = "no sitemap, no contact links, homepage unreachable"
ERROR_NO_EMAILS = "no emails found on checked pages"
ERROR_NO_EMAILS_RENDERED = "no emails found on checked pages (incl. JS-rendered)"
ERROR_ALL_FAILED = (
    "pages failed to fetch (0 of {n} candidate page(s) "
    'returned a response — not a genuine "no email" result)'
)
ERROR_GAVE_UP = (
    "gave up after {seconds}s - domain appears stuck "
    "beyond normal timeouts (e.g. a DNS/TLS-level stall)"
)
