"""Fixed values that results depend on: names, patterns, thresholds and word lists."""

# Thread states.
THREAD_STATES = ["RUNNABLE", "BLOCKED", "WAITING", "TIMED_WAITING", "NEW", "TERMINATED"]

# J9 state letters; any other letter means RUNNABLE.
J9_STATES = {"R": "RUNNABLE", "B": "BLOCKED", "W": "WAITING", "T": "TIMED_WAITING"}

# Text that marks a J9 dump.
J9_MARKERS = ["Java dump", "1TISIGINFO", "3XMTHREADINFO"]

# Prefixes of frames that say nothing about the application, per dump format.
JVM_PREFIXES_JSTACK = ["java.", "jdk.", "sun.", "com.sun.", "javax.", "[Ljava.", "jdk.internal."]
JVM_PREFIXES_J9 = ["java/", "jdk/", "sun/", "com/sun/", "javax/", "java.", "jdk.", "sun.", "com.sun.", "javax."]
JVM_PREFIXES_DISPLAY = ["jdk.", "java.", "sun.", "com.sun.", "javax."]

# Starts of garbage-collector and housekeeping thread names, per dump format.
GC_NAMES_JSTACK = [
    "GC ", "Gang ", "G1 ", "ConcurrentMark", "concurrent mark", "ZWorker", "ZDirector", "ZStat", "ZRemap",
    "Shenandoah", "VM Thread", "Finalizer", "Reference Handler", "Signal Dispatcher",
]
GC_NAMES_J9 = ["GC ", "MM ", "Finaliz", "J9VMGCCompact", "MemoryAlarm", "GCWorker"]
GC_NAMES_GENERIC = [
    "GC ", "Gang ", "G1 ", "ConcurrentMark", "concurrent mark", "ZWorker", "Shenandoah", "MM ", "GCWorker",
]

# Frame starts (jstack, generic) and frame parts (J9) that mean input or output.
IO_STARTS_JSTACK = ["java.io.", "sun.nio.", "java.net."]
IO_STARTS_GENERIC = ["java.io.", "sun.nio."]
IO_PARTS_J9 = ["java/io/", "java/net/"]

HTTP_VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]

# A timed-waiting stack holding one of these is an idle pool worker.
IDLE_FRAME_PARTS = [
    "BlockingArrayQueue", "DelayedWorkQueue", "LinkedBlockingQueue.take", "ThreadGate.await", "ReferenceQueue",
    "CleanerImpl", "ForkJoinPool.awaitWork", "AbstractEventExecutor", "NioEventLoop", "EventDispatcher",
    "ThreadPoolExecutor.getTask",
]

SIGNATURE_FRAMES = 3
STORED_FRAMES = 8
STORED_WAITERS = 20
THREAD_COUNT_THRESHOLD = 500
IO_RATIO_THRESHOLD = 0.15
DOMINANT_FINGERPRINTS = 10
SINGLE_DUMP_DOMINANT_COUNT = 50

# Columns of one access-log event, by raw key.
CDN_FIELDS = [
    "url", "cache_status", "fastly_info_state", "response_x_cache", "status", "origin_status", "server_datacenter",
    "server_region", "server_hostname", "bot_name", "request_user_agent", "client_ip", "client_as_number",
    "client_as_name", "response_age", "response_ttl", "is_cacheable", "fetch_action", "cache_location",
    "shielding_used", "content_type", "fetch_surrogate_control", "fetch_cache_control", "ddos_action", "ddos_rule",
    "malicious_flags", "deny_reason", "geo_country_code", "aem_service", "aem_tier", "time_start", "origin_host",
    "original_x_forwarded_for", "xdata.request_via", "response_vary",
]

MAX_EVENTS = 100_000
MAX_BASELINE_DAYS = 2
DEFAULT_TIER = "publish"

# Delegation domains of known content networks.
CDN_SUFFIXES = [
    ("akamaiedge.net", "akamai"), ("akamaized.net", "akamai"), ("akamaihd.net", "akamai"),
    ("akamaitechnologies.com", "akamai"), ("edgekey.net", "akamai"), ("edgesuite.net", "akamai"),
    ("cloudflare.net", "cloudflare"), ("fastly.net", "fastly"), ("fastlylb.net", "fastly"),
    ("cloudfront.net", "amazon"), ("azureedge.net", "microsoft"), ("azurefd.net", "microsoft"),
    ("trafficmanager.net", "microsoft"), ("googleusercontent.com", "google"), ("ghs.google.com", "google"),
    ("googlehosted.com", "google"), ("llnwd.net", "limelight"), ("lldns.net", "limelight"),
    ("edgecastcdn.net", "edgecast"), ("systemcdn.net", "edgecast"), ("stackpathcdn.com", "stackpath"),
    ("incapdns.net", "imperva"), ("impervadns.net", "imperva"), ("sucuri.net", "sucuri"), ("cdn77.net", "cdn77"),
    ("kxcdn.com", "keycdn"), ("gcorelabs.net", "gcore"), ("gcdn.co", "gcore"),
]
MAX_CNAME_HOPS = 10

# Words that mark a network name as cloud or hosting (a parameter of the metric job).
CLOUD_WORDS = [
    "akamai", "cloudflare", "fastly", "amazon", "aws", "microsoft", "azure", "google", "limelight", "edgecast",
    "stackpath", "imperva", "incapsula", "sucuri", "cdn77", "keycdn", "gcore", "digitalocean", "linode", "ovh",
    "hetzner", "oracle", "alibaba", "tencent", "vultr", "leaseweb", "contabo", "hosting", "datacenter", "cloud",
]

# Request headers whose use in Vary makes a cache entry per client.
HIGH_CARDINALITY_VARY = ["User-Agent", "Cookie", "Authorization", "X-Forwarded-For", "Accept-Language"]

BLANK_FLAGS = ["", "-", "none"]
SHORT_TTL_SECONDS = 60
MIN_TTL_GAPS = 10
TTL_STEPS = [60, 300, 900, 1800, 3600, 7200, 14400, 43200, 86400, 604800]
SWR_FLOOR_SECONDS = 604800
RARE_POP_SHARE = 0.01
TOP_K = 10

# Evidence types by file name and content.
IMAGE_ENDINGS = [".png", ".jpg", ".jpeg", ".gif"]
DISCOVERED_IMAGE_ENDINGS = [".png", ".jpg", ".jpeg", ".gif", ".webp"]
DUMP_NAME_PARTS = ["threaddump", "thread-dump", "thread_dump"]
DUMP_NAME_ENDINGS = [".tdump", ".jfr"]
EVIDENCE_LABELS = {
    "thread-dump": "Thread dump", "log-export": "Log export", "top-output": "Top output",
    "screenshot": "Screenshot", "generic": "Evidence",
}
CLOSED_CASES_LIMIT = 30

# Warnings of a report, as readers of reports match them.
NO_MISS_WARNING = "No cache MISS events in the analysed window — nothing to attribute."
NO_BASELINE_WARNING = "POP baseline query returned no data — using in-window rarity heuristic."
FAILED_BASELINE_WARNING = "POP baseline query failed ({}) — using in-window rarity heuristic."

# Fixed value: names shown with a stuck stack.
STUCK_STACK_NAMES = 10
