"""Fixed values.

Word lists, patterns and limits below decide results, so they are stated
plainly, in their natural order.  They are values, not logic.
"""

# --- white space -----------------------------------------------------------
# Characters Python's ``str.split()`` and ``\s`` treat as white space, written
# so that Java regular expressions and RE2 read them alike.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# --- fixed values: text ----------------------------------------------------
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
EMAIL_MASK = "[EMAIL]"

STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "up", "about", "into", "through", "during",
    "before", "after", "above", "below", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "must", "can", "this",
    "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
)
WORD_BUCKET = 100
CHAR_BUCKET = 1000
MIN_SIGNIFICANT_LENGTH = 4
TOP_WORDS = 10

# --- fixed values: urls ----------------------------------------------------
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "ref", "source", "campaign",
)
SKIP_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "bmp", "svg", "webp",
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "zip", "rar", "tar", "gz", "exe", "dmg", "iso",
    "mp3", "mp4", "avi", "mov", "wmv", "flv",
    "css", "js", "ico", "woff", "woff2", "ttf", "eot",
)

# --- fixed values: html ----------------------------------------------------
MAIN_SELECTORS = ("main", "article", '[role="main"]', ".content", ".main-content", "#content", "#main")
UNWANTED_TAGS = ("nav", "footer", "aside")
UNWANTED_CLASSES = ("sidebar", "navigation", "menu")
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\xa0", "&copy;": "\xa9", "&middot;": "\xb7"}

# --- fixed values: fetching ------------------------------------------------
TEXT_TYPES = (
    "text/html", "text/plain", "text/xml", "application/xml",
    "application/xhtml+xml", "application/json", "application/ld+json",
)
MAX_BODY_BYTES = 10 * 1024 * 1024
ERROR_ROBOTS = "Blocked by robots.txt"
ERROR_NON_TEXT = "Non-text content type"
ERROR_TIMEOUT = "Request timeout"
ROBOTS_TTL_SECONDS = 3600

# --- fixed values: crawling ------------------------------------------------
PRIORITY_LOW, PRIORITY_NORMAL, PRIORITY_HIGH, PRIORITY_CRITICAL = 1, 2, 3, 4
MAX_DEPTH = 5
POLITENESS_DELAY = 1.0
RETRY_ATTEMPTS = 3
REPORT_SECONDS = 30
HASH_RETENTION_DAYS = 30

# --- fixed values: metrics and logs ----------------------------------------
METRIC_HISTORY = 1000
METRIC_EXPORT = 100
# Default buckets of the public Prometheus client libraries.
HISTOGRAM_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
METRIC_DESCRIPTIONS = {
    "urls_crawled_total": "URLs crawled",
    "response_time_seconds": "HTTP response time",
    "http_responses_total": "HTTP responses by status code",
    "pages_stored_total": "Pages stored",
    "bytes_downloaded_total": "Bytes downloaded",
    "errors_total": "Crawl errors",
    "duplicates_skipped_total": "Duplicate pages skipped",
    "queue_size": "URLs in queue",
    "active_workers": "Active workers",
}
NOISY_LOGGERS = ("aiohttp.access", "urllib3.connectionpool", "requests.packages.urllib3")
NOISY_DEBUG_PHRASES = ("connection pool", "resetting dropped connection")
STORAGE_VERSION = "1.0"
