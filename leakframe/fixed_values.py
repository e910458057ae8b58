"""Fixed values.

Word lists, extensions, patterns and formats that have to be exactly these for the
results to be right.  They are plain data in natural order; nothing here is logic.
Patterns are written in the common dialect and pass through ``functions.regex``
before they reach Spark.
"""

# --------------------------------------------------------------------------- severities
SEVERITIES = ["critical", "high", "medium", "low", "info"]
SEVERITY_SCORE = {"critical": 100, "high": 80, "medium": 50, "low": 20, "info": 0}
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}

# --------------------------------------------------------------------------- size limits
MAX_FILE_SIZE = 500_000
LARGE_OBJECT_BYTES = 100 * 1024 * 1024
MIN_ENTROPY = 4.5
MIN_ENTROPY_LENGTH = 20
REMOVED = "***REMOVED***"

# --------------------------------------------------------------------------- path filters
SKIP_EXTENSIONS = [
    ".tgz", ".tar", ".gz", ".zip", ".rar", ".7z",
    ".exe", ".dll", ".so", ".dylib", ".bin",
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".webp",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".wmv",
    ".ttf", ".otf", ".woff", ".woff2", ".eot",
    ".pyc", ".pyo", ".class", ".o", ".obj",
    ".sqlite", ".db", ".sqlite3",
    ".pack", ".idx",
]
FAST_SKIP_EXTENSIONS = [
    ".tgz", ".tar", ".gz", ".zip", ".rar", ".7z",
    ".exe", ".dll", ".so", ".dylib", ".bin",
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".webp",
    ".pdf", ".mp3", ".mp4", ".ttf", ".woff", ".woff2",
    ".pyc", ".class", ".sqlite", ".db", ".pack", ".idx",
]
HISTORY_SKIP_EXTENSIONS = [
    ".tgz", ".tar", ".gz", ".zip", ".rar", ".7z",
    ".exe", ".dll", ".so", ".dylib", ".bin",
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".webp", ".bmp",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".wmv", ".webm",
    ".ttf", ".otf", ".woff", ".woff2", ".eot",
    ".pyc", ".pyo", ".class", ".o", ".obj",
    ".sqlite", ".db", ".sqlite3",
    ".pack", ".idx",
    ".jar", ".war", ".ear",
    ".node", ".map",
    ".aab", ".apk", ".dex", ".aar",
    ".xcassets", ".storyboard", ".xib",
    ".lock", ".sum",
    ".icns",
]
HISTORY_SKIP_NAMES = [
    "gradlew", "gradlew.bat", "gradle-wrapper.jar",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    ".gitignore", ".gitattributes", "LICENSE", "CHANGELOG.md",
]
HISTORY_SKIP_DIRS = [
    "node_modules", ".gradle", "build", ".idea", ".vscode",
    "__pycache__", ".git", "vendor", "Pods",
]
FAST_SKIP_PATH = [
    r"\.min\.(js|css)$", r"\.bundle\.js$", r"\.chunk\.js$", r"\.map$",
    r"/vendor/", r"/node_modules/", r"/dist/", r"/build/",
    r"\.css$", r"package-lock\.json$", r"yarn\.lock$",
    r"\.(suo|user|DotSettings|csproj|vbproj|fsproj|scss|less)$",
]

# --------------------------------------------------------------------------- entropy operator
QUOTED_CANDIDATE = r"""["']([^"'\n]{20,})["']"""
BARE_CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
FAST_MAX_LINE = 500
ENTROPY_VALUE_SKIP = [  # case-insensitive
    r"^(INSERT|UPDATE|DELETE|SELECT|CREATE|ALTER|DROP)\s",
    r"^https?://",
    r"^gcr\.io/",
    r"^docker\.io/",
    r"^[a-z0-9\-]+\.[a-z]{2,}$",
    r"^/[a-z0-9/_\-]+$",
    r"PublicKeyToken=",
    r"Version=\d+\.\d+\.\d+\.\d+",
    r"Culture=\w+",
    r"^(System|Microsoft|Newtonsoft)\.[A-Za-z.]+",
    r"xmlns",
    r"http://schemas\.(xmlsoap|microsoft|openxmlformats)\.",
    r"http://www\.w3\.org/",
]
ENTROPY_VALUE_SKIP_CASED = [
    r"^\$[A-Z_]+",
    r"^\w+\s+\w+\s+\w+\s+\w+",
    r"^\$\([^)]+\)$",
    r"%\([^)]+\)",
]
ENTROPY_PATH_SKIP = [
    ".csproj", ".vbproj", ".fsproj", ".vcxproj", ".props", ".targets", ".config", ".resx", ".settings",
    ".min.js", ".min.css", ".bundle.js", ".chunk.js",
    ".css", ".map",
    "/vendor/", "/node_modules/", "/dist/", "/build/",
    "package-lock.json", "yarn.lock", "composer.lock",
]
ENTROPY_CRITICAL = [  # pattern, type, wording
    (r"AAAA[A-Za-z0-9_-]{7}:[A-Za-z0-9_-]{100,}", "api_key", "Firebase Cloud Messaging (FCM) Server Key"),
    (r'password\s*=\s*[^;"\s]+', "database_password", "Database connection string with password"),
    (r"[A-Za-z0-9+/]{40,}={1,2}$", "secret_key", "Base64 encoded key (likely JWT/signing key)"),
    (r"AKIA[A-Z0-9]{16}", "aws_access_key", "AWS Access Key"),
    (r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----", "private_key", "Private Key"),
    (r"^(sk_live_|pk_live_|rk_live_)", "api_key", "Stripe API Key"),
    (r"^(ghp_|gho_|ghu_|ghs_|ghr_)", "github_token", "GitHub Token"),
    (r"^xox[baprs]-", "auth_token", "Slack Token"),
]
ENTROPY_HIGH = [  # tested on the lowercased line
    (r"(api[_-]?key|secret[_-]?key|auth[_-]?token|access[_-]?token)", "api_key", "API Key or Token"),
    (r"server[_-]?key", "api_key", "Server Key"),
    (r"(signing[_-]?key|encryption[_-]?key)", "secret_key", "Signing/Encryption Key"),
    (r"bearer\s+[a-z0-9._-]+", "auth_token", "Bearer Token"),
    (r"(passwd|pwd)\s*[=:]", "password", "Password"),
]

# --------------------------------------------------------------------------- match splitting
JSON_VALUE = (
    r"(?:Key|Secret|Password|Token|ApiKey|ClientSecret|secretKey|privateKey|authKey)"
    r'\s*"\s*:\s*"([^"]+)"'
)
JSON_KEY = r'(\w+)"\s*:'
CONNECTION_PASSWORD = r"""Password\s*=\s*([^;"'\s]+)"""
ASSIGNMENT = r"""^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*[=:]\s*["']?(.+?)["']?$"""
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"
FAST_JSON_PAIR = r'"([^"]+)"\s*:\s*"([^"]+)"'
FAST_BROKEN_JSON = r'(\w+)"\s*:\s*"([^"]+)"'

# --------------------------------------------------------------------------- suppression families
FP_PATHS = [
    r"\.min\.js$", r"\.min\.css$", r"\.bundle\.js$", r"\.chunk\.js$", r"\.map$",
    r"/vendor/", r"/node_modules/", r"/dist/", r"/build/",
    r"\.css$", r"package-lock\.json$", r"yarn\.lock$", r"composer\.lock$",
    r"\.suo$", r"\.user$", r"\.DotSettings\.user$", r"\.DotSettings$", r"karma\.conf\.js$",
    r"\.csproj$", r"\.vbproj$", r"\.fsproj$", r"\.scss$", r"\.less$",
]
FP_HTML = [
    r"^\s*>", r"<\w+", r"\{\{[\w.]+\}\}", r"\*ngIf", r"\*ngFor", r"\[[\w.]+\]", r"\([\w.]+\)",
    r"class\s*=", r"style\s*=", r"<mat-", r"<span|<div|<p>|<a\s", r"&gt;|&lt;|&amp;",
    r"<strong>|<del>|<em>",
]
FP_ANDROID = [
    r"schemas\.android\.com",
    r"xmlns:(android|app|tools)=",
    r"android:(layout_|id=|background=|textColor=|fontFamily=|orientation=|padding|margin|shape=)",
    r"tools:context=",
    r"@(drawable|color|font|style|android:style)/",
    r"<(Linear|Relative|Frame|Constraint)Layout",
    r"<(item|shape|solid|corners|stroke|style|selector)[\s>]",
    r"match_parent", r"wrap_content",
    r"android:state_",
    r"@\+id/",
]
FP_CSHARP = [
    r"\.Sum\s*\(\s*\w+\s*=>\s*\w+\.\w+\)", r"Convert\.To\w+\(", r"\.Split\s*\(",
    r"\{\w+\}\s*\{\w+\}", r'^\s*\w+\s*=\s*"[^"]*";\s*$', r"urn:\w+:",
    r"@EntryIndexedValue", r"/Default/CodeStyle/", r"AutoDetectedNamingRules",
]
FP_PUBLIC_URL = [
    r"^https?://(www\.)?nodejs\.org", r"^https?://(www\.)?material\.io",
    r"^https?://(www\.)?karma-runner\.github\.io", r"^https?://(www\.)?github\.com",
    r"^https?://(www\.)?npmjs\.com", r"^https?://(www\.)?docs\.",
    r"^https?://[a-z0-9.-]+\s*(,|$)",
]
URL_CREDENTIAL_6 = r"(password|pwd|secret|key|token|auth)=\w{6,}"
FP_LOG = [r"GetFlights with \{", r"@response\}", r"response:\s*\{@", r"\./mobileHub/"]
FP_ALPHABET_LITERAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
FP_ALPHABET = [r"^[A-Z]{26}[0-9]+$"]
UNPRINTABLE_SHARE = 0.3
FP_MINIFIED = [
    r"\}var\s+\w+=", r",\w+=this\.", r"\.prototype\.\w+=function", r"return\s*!\d+===",
    r"\w+\.\w+\.\w+\.\w+\(", r"function\s*\(\w\)\{", r"\}\)\(\w+\)", r":\{\},\w+:\{\}",
    r"\w+\|\|\(\w+=\{\}\)", r",\w+\.\w+=\w+\.\w+,", r'\w+\["\w+"\]=', r"\.call\(this,\w+\)",
    r"\.apply\(this,arguments\)", r"\?\w+\(\w+\):void\s+0",
]
FP_JS = [
    r"^var\s+\w+=", r"^let\s+\w+=", r"^const\s+\w+=", r"^function\s*\w*\s*\(",
    r"^return\s+(this|true|false|null)", r"\.innerHTML\}?", r"\.offsetHeight", r"\.appendChild\(",
    r"\.getElementById\(", r"\.querySelector\(", r"\.addEventListener\(", r"\.createElement\(",
    r"\.setAttribute\(", r"\.classList\.", r"\.style\.\w+\s*=", r"document\.\w+", r"window\.\w+",
    r"this\.\w+\s*=", r"new\s+Array\(", r"new\s+Object\(", r"JSON\.(parse|stringify)\(",
    r"Array\.prototype\.", r"Object\.(keys|values|entries)\(", r"Math\.(floor|ceil|round|random)",
    r"parseInt\(|parseFloat\(", r"typeof\s+\w+", r"instanceof\s+\w+", r"\.hasOwnProperty\(",
    r"\.filter\(function", r"\.map\(function", r"\.forEach\(function", r"\.reduce\(function",
    r"\?\w+\.\w+:\w+\.\w+",
]
FP_DATA_URI = [
    r"data:(image|font|application)/(png|jpeg|gif|svg|woff|woff2|ttf|otf|octet-stream)",
]
FP_CSS_BASE64 = [r"^[A-Za-z0-9+/]{50,}={0,2}$"]
FP_IDENTIFIER = [r"^[A-Z][a-z]+([A-Z][a-z]+)+$", r"^[a-z]+([A-Z][a-z]+)+$"]
FP_CSS = [
    r"font-size\s*:", r"font-weight\s*:", r"font-family\s*:", r"color\s*:\s*#[0-9a-fA-F]",
    r"background-color\s*:", r"background\s*:\s*(#|rgba?|url)", r"border\s*:", r"border-radius\s*:",
    r"margin\s*:", r"padding\s*:", r"width\s*:\s*\d+", r"height\s*:\s*\d+", r"max-width\s*:",
    r"min-width\s*:", r"max-height\s*:", r"min-height\s*:",
    r"display\s*:\s*(flex|block|inline|none|grid)",
    r"position\s*:\s*(absolute|relative|fixed|static)",
    r"text-align\s*:", r"text-decoration\s*:", r"line-height\s*:", r"overflow\s*:", r"z-index\s*:",
    r"opacity\s*:", r"visibility\s*:", r"box-shadow\s*:", r"transition\s*:", r"transform\s*:",
    r"flex\s*:", r"align-items\s*:", r"justify-content\s*:", r"letter-spacing\s*:",
    r"vertical-align\s*:", r"list-style-type\s*:", r"sans-serif", r"Roboto", r"Helvetica", r"Arial",
    r"pointer-events\s*:", r"box-sizing\s*:",
]
URL_TEMPLATE_START = [r"^\./|^/\w"]
URL_TEMPLATE_SLOT = [r"\{[a-zA-Z_][a-zA-Z0-9_.]*(:.*?)?\}"]
URL_CREDENTIAL_1 = r"(password|secret|key|token|auth)=\w+"
FP_CODE = [
    r"^\s*!!\w+\.", r"\s*&&\s*", r"\s*\|\|\s*", r"\.length\s*[><=]", r"\.indexOf\s*\(",
    r"\.ToString\s*\(", r"\.Value\s*[}\]]", r"\?\s*\w+\s*:", r"^\s*\w+\s*\?\?", r";\s*else\s+\w+",
    r"^\s*preview\s*\|\|", r"\bcanAdd\w+\b", r"^\s*\(\s*!", r"\$\{[\w.]+\}", r"\{\{[\w.]+\}\}",
    r"\bstring\.Join\s*\(", r"\bOldValue\s*=", r"\bNewValue\s*=", r"destination\.\w+\?\.",
    r"Groups\[\d+\]", r"match\.Groups",
]
FP_HEADERS = [
    r"^max-age=\d+", r"includeSubDomains", r"^\s*preload\s*$", r"Content-Security-Policy",
    r"X-Frame-Options", r"X-Content-Type-Options",
]
FP_CDN = [
    r"unpkg\.com/", r"cdnjs\.", r"jsdelivr\.", r"gstatic\.com/", r"googleapis\.com/",
    r"firebaseio\.com[/\s]", r"bootstrapcdn\.", r"cloudflare\.com/",
]
URL_CREDENTIAL_8 = r"(password|key|token|secret|auth)=\w{8,}"
FP_UI_TEXT = [
    r"Pozisyonu\s*\{", r"adresine\s+mail", r"Lütfen\s+\w+", r"Misafirlerimizi", r"gönderilmiştir",
    r"\\n\s*\*\*\{", r'UserName\s*=\s*"[A-Z]+"',
]
FP_ANGULAR = [
    r"^\s*\*ngIf\s*=", r"^\s*\*ngFor\s*=", r"\[ngClass\]", r"\(click\)\s*=",
    r"""style\s*=\s*["']?$""", r"><span\s+style", r"</span><span", r"""class\s*=\s*["']""",
]
FP_CALLS = [r"^open\w+Modal\s*\(", r"^open\w+\s*\(", r"item\.\w+_LegIsn", r"item\.RegSerial"]
CREDENTIAL_PREFIXES = [
    "^AKIA", "^ABIA", "^ACCA", "^AGPA", "^AIDA", "^AIPA", "^ANPA", "^ANVA", "^APKA", "^AROA",
    "^ASCA", "^ASIA", "^ghp_", "^gho_", "^ghu_", "^ghs_", "^ghr_", "^xox[baprs]-", "^sk-", "^pk_",
    "^rk_", "^AIza", r"^ya29\.",
]
ONE_WORD = [r"^[A-Za-z][A-Za-z0-9]*$"]
ONE_WORD_MAX = 30
ONE_WORD_ENTROPY = 3.5
FP_FORMAT = [r"\{[0-9]+\}"]
FP_NAMESPACE = [r"xmlns(:\w+)?=", r"http://schemas\.", r"http://www\.w3\.org/"]
FP_ASSEMBLY = [
    r"PublicKeyToken=", r"Version=\d+\.\d+\.\d+\.\d+", r"Culture=neutral", r"\.dll",
    r"<Reference\s+Include=", r"<PackageReference",
]
TEST_PATH = [r"(test|spec|mock|fake|stub|fixture)s?[/\\.]"]
TEST_ENTROPY = 3.0
FP_PLACEHOLDER = [
    r"^(xxx+|yyy+|zzz+)$", r"^(your|my|test|sample|example)[_-]?\w*$", r"^[<\[{].*[>\]}]$",
    r"^\$\{.*\}$", r"^\$\([^)]+\)$", r"^%[A-Z_]+%$", r"^@\w+$",
]
FP_DOC_DOMAINS = [
    "docs.", "documentation.", "api.", "learn.", "developer.", "msdn.", "technet.",
    "stackoverflow.com", "github.com/.*/(blob|tree)/", "wikipedia.org", "w3schools.com",
]
FAST_HTML = [
    r"^\s*>", r"<\w+", r"\{\{[\w.]+\}\}", r"\*ng[IF]or", r"class\s*=", r"style\s*=", r"<span", r"<div",
]
FAST_CODE = [
    r"\.Sum\s*\(", r"Convert\.To", r"\.Split\s*\(", r"\{.*\}\s*\{.*\}", r"urn:\w+:",
]
FAST_MINIFIED = [
    r"\}var\s+\w+=", r",\w+=this\.", r"\.prototype\.\w+=function", r"function\s*\(\w\)\{",
]
FAST_JS = [
    r"^var\s+\w+=", r"^let\s+\w+=", r"^const\s+\w+=", r"document\.\w+", r"window\.\w+",
    r"this\.\w+\s*=",
]
FAST_CSS = [
    r"(font-size|font-weight|color\s*:|background|border|margin|padding|width|height|display|position):",
]
FAST_ANGULAR = [r"\$event", r"_Changed\s*\(", r"\{\{row\.", r"\?.*:.*\}\}"]
FAST_PLACEHOLDER = [r"^(xxx+|yyy+|test_|sample_|example_|<.*>|\$\{.*\}|%\w+%)$"]
FAST_LITERALS = ["TotalPax", "182+80"]

# --------------------------------------------------------------------------- review hints
HINT_TEXT = {
    "pin": "SSL Certificate Pin (public key hash) - NOT a secret, safe to keep",
    "hash": "Likely a certificate pin or public hash - NOT a secret",
    "doc_url": "Looks like a documentation/schema URL - NOT a secret",
    "namespace": "Android XML namespace - NOT a secret",
    "library": "Android library reference - NOT a secret",
    "package": "Package name or host configuration - usually NOT a secret",
    "code": "Looks like code/variable name",
    "placeholder": "Generic placeholder value",
    "short": "Very short value - might not be a real secret",
    "comment": "Looks like a comment",
    "test_class": "Looks like test/adapter class name",
    "provider": "Android FileProvider path - NOT a secret",
}
HINT_DOC_URL = [
    "android.com", "google.com/tools", "developer.", "docs.", "example.com", "localhost",
    "127.0.0.1", "schemas.", "w3.org", "xml", "xmlns",
]
HINT_CODE = [
    ".lowercase()", ".uppercase()", ".tostring()", "fullname", "getname", "setname", "username:",
    "placeholder", "example", "sample", "passenger:",
]
HINT_PLACEHOLDER = ["password", "secret", "test", "demo", "example", "placeholder"]
HINT_COMMENT = ["#", "//", "/*", "*", "--"]
HINT_HASH_LENGTHS = [44, 64, 88]

# --------------------------------------------------------------------------- value shapes
SHAPE_PREFIXES = [
    "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "AKIA", "ABIA", "ACCA", "AGPA", "AIDA",
    "sk-", "pk-", "xoxb-", "xoxp-", "xoxa-", "sha256/", "sha1/", "eyJ",
]

# --------------------------------------------------------------------------- names
ENV_BY_TYPE = {
    "password": "PASSWORD", "database_password": "DB_PASSWORD", "database_host": "DB_HOST",
    "database_name": "DB_NAME", "database_user": "DB_USER", "database_port": "DB_PORT",
    "api_key": "API_KEY", "secret_key": "SECRET_KEY", "aws_access_key": "AWS_ACCESS_KEY_ID",
    "aws_secret_key": "AWS_SECRET_ACCESS_KEY", "github_token": "GITHUB_TOKEN", "hostname": "HOST",
    "ip_address": "HOST_IP", "port": "PORT", "url": "API_URL", "username": "USERNAME",
    "auth_token": "AUTH_TOKEN", "jwt_token": "JWT_SECRET",
}
ENV_GENERIC_STEMS = ["CONFIG", "SETTINGS", "ENV", "SECRETS", "MAIN"]
FAST_GENERIC_STEMS = ["CONFIG", "SETTINGS", "ENV"]
HISTORY_GENERIC_NAMES = [
    "CONFIG", "SETTINGS", "ENV", "SECRETS", "APPSETTINGS", "SRC", "MAIN", "APP", "RES", "VALUES",
]
HISTORY_ENV_BY_TYPE = {
    "aws_key": "AWS_ACCESS_KEY_ID", "aws_secret": "AWS_SECRET_ACCESS_KEY",
    "github_token": "GITHUB_TOKEN", "api_key": "API_KEY", "database_url": "DATABASE_URL",
    "password": "DB_PASSWORD", "private_key": "PRIVATE_KEY", "jwt_token": "JWT_SECRET",
    "oauth_secret": "OAUTH_CLIENT_SECRET", "encryption_key": "ENCRYPTION_KEY",
}
OLD_GENERIC_STEMS = ["CONFIG", "SETTINGS", "ENV", "SECRETS", "APPSETTINGS"]
VALUE_KEYWORDS = [
    ("firebase", "FIREBASE"), ("google", "GOOGLE"), ("maps", "MAPS"), ("api", "API"), ("auth", "AUTH"),
    ("oauth", "OAUTH"), ("jwt", "JWT"), ("database", "DB"), ("postgres", "POSTGRES"),
    ("mysql", "MYSQL"), ("mongo", "MONGO"), ("redis", "REDIS"), ("aws", "AWS"), ("azure", "AZURE"),
    ("stripe", "STRIPE"), ("twilio", "TWILIO"), ("sendgrid", "SENDGRID"), ("slack", "SLACK"),
    ("github", "GITHUB"), ("gitlab", "GITLAB"), ("bitbucket", "BITBUCKET"),
]
REPORT_ENV_BY_TYPE = {
    "azure_sql": "AZURE_SQL_PASSWORD", "sql_server": "SQL_PASSWORD",
    "database_password": "DB_PASSWORD", "rabbitmq": "RABBITMQ_PASSWORD", "fcm": "FCM_SERVER_KEY",
    "jwt": "JWT_SECRET", "vapid": "VAPID_PRIVATE_KEY", "api_key": "API_KEY",
    "aws_access_key": "AWS_ACCESS_KEY_ID", "aws_secret_key": "AWS_SECRET_ACCESS_KEY",
    "password": "PASSWORD",
}
GENERATED_ENV_BY_TYPE = {
    "aws_access_key": "AWS_ACCESS_KEY_ID", "aws_secret_key": "AWS_SECRET_ACCESS_KEY",
    "github_token": "GITHUB_TOKEN", "gitlab_token": "GITLAB_TOKEN",
    "bitbucket_token": "BITBUCKET_TOKEN", "database_connection": "DATABASE_URL",
    "private_key": "PRIVATE_KEY", "ssh_key": "SSH_PRIVATE_KEY", "api_key": "API_KEY",
    "password": "PASSWORD", "jwt_token": "JWT_SECRET", "oauth_secret": "OAUTH_CLIENT_SECRET",
    "encryption_key": "ENCRYPTION_KEY", "generic_secret": "SECRET_VALUE",
}

# --------------------------------------------------------------------------- classes
TYPE_BY_RULE_NAME = [
    ("password", "password"), ("api_key", "api_key"), ("api-key", "api_key"), ("apikey", "api_key"),
    ("token", "token"), ("private_key", "private_key"), ("private-key", "private_key"),
    ("certificate", "certificate"), ("cert", "certificate"),
    ("connection_string", "connection_string"), ("connectionstring", "connection_string"),
    ("encryption", "encryption_key"), ("credential", "credential"), ("aws", "aws_key"),
    ("azure", "azure_key"), ("gcp", "gcp_key"), ("google", "gcp_key"), ("ssh", "ssh_key"),
    ("jwt", "jwt"),
]
ENV_FILE_GROUPS = [
    ("database", ["sqlserver", "database_password", "mongodb", "mysql", "postgres"]),
    ("api_keys", ["api_key", "gcp_api_key", "aws_key"]),
    ("auth", ["jwt", "oauth", "bearer", "private_key", "rsa_key", "azure_client_secret"]),
    ("cloud", ["azure", "aws", "gcp", "firebase"]),
    ("other", ["generic_secret", "base64_secret"]),
]
CONFIG_NAMES = [
    ".env", ".env.example", "config.json", "config.yaml", "config.yml", "settings.json",
    "settings.yaml", "appsettings.json",
]
CONFIG_EXTENSIONS = [".yaml", ".yml", ".json", ".toml", ".ini", ".cfg"]
LANGUAGE_BY_EXTENSION = {
    ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".py": "python", ".js": "javascript",
    ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go",
    ".rb": "ruby", ".php": "php", ".cs": "csharp", ".yaml": "yaml", ".yml": "yaml", ".json": "json",
    ".properties": "properties", ".ini": "ini", ".env": "bash",
}
LANGUAGE_BY_NAME = {"Dockerfile": "dockerfile"}
ENV_REFERENCE = {  # {} is the variable name
    "bash": "${{{}}}", "python": "os.environ.get('{}')", "javascript": "process.env.{}",
    "typescript": "process.env.{}", "java": 'System.getenv("{}")', "go": 'os.Getenv("{}")',
    "ruby": "ENV['{}']", "php": "getenv('{}')", "csharp": 'Environment.GetEnvironmentVariable("{}")',
    "yaml": "${{{}}}", "json": "${{{}}}", "properties": "${{{}}}", "ini": "${{{}}}",
    "dockerfile": "${{{}}}", "unknown": "${{{}}}",
}
LANGUAGE_IMPORT = {"python": "import os", "go": '"os"'}
PLACEHOLDER_BY_CATEGORY = {
    "azure_sql": "AZURE_SQL_PASSWORD_REMOVED", "sql_server": "ONPREM_SQL_PASSWORD_REMOVED",
    "database_password": "DB_PASSWORD_REMOVED", "rabbitmq": "RABBITMQ_PASSWORD_REMOVED",
    "fcm": "FCM_SERVER_KEY_REMOVED", "jwt": "JWT_SECRET_KEY_REMOVED",
    "vapid": "VAPID_PRIVATE_KEY_REMOVED", "api_key": "API_KEY_REMOVED",
    "secret_key": "SECRET_KEY_REMOVED", "password": "PASSWORD_REMOVED",
    "aws_access_key": "AWS_ACCESS_KEY_REMOVED", "aws_secret_key": "AWS_SECRET_KEY_REMOVED",
    "internal_ip": "INTERNAL-SERVER", "internal_domain": "INTERNAL-DOMAIN",
    "ldap": "LDAP_PASSWORD_REMOVED", "base64_secret": "BASE64_SECRET_REMOVED",
    "generic_secret": "***REMOVED***",
}
TECH_IN_TEXT = {
    ".NET Core / ASP.NET Core": [r"\.csproj", r"appsettings\.json", r"Startup\.cs", r"Program\.cs"],
    "Entity Framework Core": [r"DbContext", r"Microsoft\.EntityFrameworkCore"],
    "Angular": [r"angular\.json", r"@angular/core", r"\.component\.ts"],
    "React": [r"react", r"\.jsx", r"\.tsx"],
    "Node.js": [r"package\.json", r"node_modules"],
    "Python": [r"\.py$", r"requirements\.txt", r"pyproject\.toml"],
    "Java / Spring": [r"\.java$", r"pom\.xml", r"build\.gradle"],
    "RabbitMQ": [r"amqp://", r"RabbitMQ", r"rabbitmq"],
    "Redis": [r"redis://", r"Redis"],
    "Azure SQL Database": [r"database\.windows\.net"],
    "SQL Server": [r"Server=.*\d+\.\d+\.\d+\.\d+"],
    "Firebase": [r"firebase", r"FCM", r"firebaseio\.com"],
    "SignalR": [r"SignalR", r"\.Hubs"],
    "Docker": [r"Dockerfile", r"docker-compose"],
}
TECH_BY_PATH = {
    "*.csproj": ".NET Core / ASP.NET Core", "*.sln": "Visual Studio Solution",
    "package.json": "Node.js", "angular.json": "Angular", "next.config.*": "Next.js",
    "vite.config.*": "Vite", "requirements.txt": "Python", "Pipfile": "Python (Pipenv)",
    "pom.xml": "Java (Maven)", "build.gradle": "Java (Gradle)", "Dockerfile": "Docker",
    "docker-compose.*": "Docker Compose", "appsettings*.json": ".NET Configuration",
    "*.proto": "gRPC / Protocol Buffers",
}
TECH_BY_CONTENT = [  # needle, extensions
    ("RabbitMQ", [".json", ".cs", ".config"]),
    ("Firebase", [".json", ".cs", ".ts"]),
    ("SignalR", [".cs", ".ts"]),
]

# --------------------------------------------------------------------------- purge selection
PURGE_COMMON_WORDS = [
    "TEST", "test", "Test", "PROD", "prod", "Prod", "DEV", "dev", "Dev", "STAGE", "stage", "Stage",
    "LOCAL", "local", "Local", "DEBUG", "debug", "Debug", "TRUE", "true", "True",
    "FALSE", "false", "False", "NULL", "null", "Null", "NONE", "none", "None",
    "PASSWORD", "password", "Password", "SECRET", "secret", "Secret",
]
FULL_VALUE_TYPES = ["connection_string_full"]
PARTIAL_VALUE_TYPES = ["sqlserver", "database_password", "connection_string_password"]

# --------------------------------------------------------------------------- verification
VERIFIER_BY_TYPE = {
    "aws_access_key": "aws", "aws_secret_key": "aws",
    "github_token": "github", "github_pat": "github", "github_fine_grained_pat": "github",
    "github_oauth": "github", "github_app_token": "github_app",
    "gitlab_token": "gitlab", "gitlab_pat": "gitlab", "gitlab_pipeline_token": "gitlab",
    "slack_bot_token": "slack", "slack_user_token": "slack", "slack_webhook": "slack_webhook",
    "stripe_api_key": "stripe", "stripe": "stripe", "stripe_restricted": "stripe",
    "twilio_api_key": "twilio", "twilio": "twilio",
    "sendgrid_api_key": "sendgrid", "sendgrid": "sendgrid",
    "openai_api_key": "openai", "openai": "openai",
    "anthropic_api_key": "anthropic", "anthropic": "anthropic",
    "huggingface_token": "huggingface", "huggingface": "huggingface",
    "mailchimp_api_key": "mailchimp", "mailchimp": "mailchimp",
    "mailgun_api_key": "mailgun", "mailgun": "mailgun",
    "datadog_api_key": "datadog", "datadog": "datadog",
    "newrelic_api_key": "newrelic", "newrelic": "newrelic",
    "heroku_api_key": "heroku", "heroku": "heroku",
    "digitalocean_pat": "digitalocean", "digitalocean": "digitalocean",
    "npm_token": "npm", "npm": "npm", "pypi_token": "pypi", "pypi": "pypi",
    "discord_webhook": "discord_webhook", "discord_bot_token": "discord_bot",
    "shopify_token": "shopify", "shopify": "shopify", "notion": "notion", "airtable": "airtable",
    "asana": "asana", "linear": "linear", "sentry_dsn": "sentry", "sentry": "sentry",
    "vault_token": "vault", "doppler_token": "doppler", "supabase": "supabase",
    "planetscale_password": "planetscale", "vercel": "vercel", "netlify_token": "netlify",
    "flyio_token": "flyio", "cloudflare": "cloudflare", "firebase": "firebase",
    "mongodb_connection": "mongodb",
}
FORMAT_CHECKS = {  # verifier: pattern, message if it fits, status and message if not
    "aws": (r"^(AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}$",
            "AWS key verification requires both access key and secret key pair",
            "unverified", "Invalid AWS access key format"),
    "slack_webhook": (r"^https://hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[a-zA-Z0-9]+",
                      "Slack webhook URL format is valid (not tested to avoid sending messages)",
                      "verified_inactive", "Invalid Slack webhook URL format"),
    "pypi": (r"^pypi-",
             "PyPI token format is valid (no verification API available)",
             "verified_inactive", "Invalid PyPI token format"),
    "sentry": (r"^https://[a-f0-9]+@[a-z0-9]+\.ingest\.sentry\.io/\d+",
               "Sentry DSN format is valid (not tested to avoid sending events)",
               "verified_inactive", "Invalid Sentry DSN format"),
    "mongodb": (r"^mongodb(\+srv)?://[^:]+:[^@]+@[^/]+",
                "MongoDB connection string format is valid (not tested to avoid connecting)",
                "verified_inactive", "Invalid MongoDB connection string format"),
}
PAIRED_CHECKS = {
    "twilio": "Twilio verification requires Account SID and Auth Token pair",
    "shopify": "Shopify token verification requires store domain",
    "vault": "Vault token verification requires server address",
    "supabase": "Supabase key verification requires project URL",
    "planetscale": "PlanetScale verification requires full connection string",
    "firebase": "Firebase API key verification requires project configuration",
}

# --------------------------------------------------------------------------- feedback and jobs
DEFAULT_KNOWN_FP = [  # pattern, confidence, reason
    ("sha256/[alnum:43]+[special:1]", 0.95, "SSL certificate pin"),
    ("http://schemas.android.com", 0.99, "Android XML namespace"),
    ("android.support.", 0.95, "Android library reference"),
    ("androidx.", 0.95, "AndroidX library reference"),
]
KNOWN_FP_REASON = "User feedback indicates this is usually not a secret"
JOB_TRANSITIONS = {
    "pending": ["cloning"],
    "cloning": ["scanning"],
    "scanning": ["scan_complete", "awaiting_selection"],
    "scan_complete": ["awaiting_selection"],
    "awaiting_selection": ["cleaning"],
    "cleaning": ["clean_complete", "uploading"],
    "clean_complete": ["pushing"],
    "uploading": ["clean_complete"],
    "pushing": ["completed"],
    "completed": [], "failed": [], "cancelled": [],
}
TERMINAL_STATES = ["completed", "failed", "cancelled"]
ACTIVE_STATES = ["cloning", "scanning", "cleaning", "uploading", "pushing"]
EXPIRY_EXEMPT_STATES = ["completed", "failed", "cancelled", "expired"]

# --------------------------------------------------------------------------- line rewriting
REWRITE_QUOTED = r"""["'][^"']*["']"""
REWRITE_MAYBE_QUOTED = r"""["']?[^"':\n]*["']?"""
REWRITE_BASH_VALUE = r"""["']?[^"']*["']?"""
REWRITE_BEFORE = {  # what stays before the value
    "javascript": r"((?:const|let|var)?\s*\w+\s*=\s*)",
    "java": r"(\s*\w+\s+\w+\s*=\s*)",
    "go": r"(\s*\w+\s*:?=\s*)",
    "ruby": r"(\s*\w+\s*=\s*)",
    "php": r"(\s*\$\w+\s*=\s*)",
}
