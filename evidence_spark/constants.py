"""Names, word lists, weights and thresholds that results depend on."""

# ---- fixed values: domain names and source markers ---------------------------------
SUPPORT_DOMAIN = "enterprise_support"
BANKING_DOMAIN = "banking_fraud"

# ---- fixed values: ticket and risk vocabularies ------------------------------------
OPEN_STATUSES = ["open", "pending_customer", "pending_engineering"]
CLOSED_STATUSES = ["resolved", "closed"]
INACTIVE_RISK_STATUSES = ["closed", "mitigated"]
BAD_SLA = ["at_risk", "breached"]
HIGH_SEVERITIES = ["high", "critical"]
HIGH_RISK_SCORE = 70
NEGATIVE_RISK_TYPES = [
    "churn_risk", "incident", "security", "sentiment_drop", "sla_breach", "usage_anomaly",
]
ESCALATION_RISK_TYPES = ["incident", "security", "sla_breach"]
LOGIN_TERMS = ["login", "sso", "scim", "session", "mfa", "auth"]
API_TERMS = ["api", "timeout", "latency", "gateway", "webhook", "504"]
REFUND_TERMS = ["refund", "billing", "credit", "invoice", "tax", "sla_credit"]

# ---- fixed values: risk features, weights and labels (order matters for ties) ------
FEATURES = [
    "ticket_count_7d", "critical_ticket_count_30d", "escalation_count_30d",
    "failed_login_count_7d", "api_timeout_count_7d", "refund_request_count_30d",
    "negative_signal_count_30d",
]
FEATURE_WEIGHTS = [8.0, 20.0, 20.0, 12.0, 12.0, 8.0, 20.0]
FEATURE_LABELS = [
    "recent support ticket volume",
    "critical or incident ticket activity",
    "SLA or engineering escalation activity",
    "recent login, SSO, MFA, or auth failures",
    "recent API timeout or latency signals",
    "billing, refund, credit, or invoice signals",
    "negative risk, incident, sentiment, or SLA signals",
]
ANOMALY_BONUS = 3.0
RISK_LEVELS = [(80.0, "critical"), (60.0, "high"), (35.0, "medium")]

# ---- fixed values: keyword rules that point a ticket at a policy -------------------
POLICY_RULES = [
    ("pol_sla", ["sla", "p1", "p2", "breach", "incident", "outage"]),
    ("pol_api_timeout", ["api", "timeout", "latency", "gateway", "webhook"]),
    ("pol_login_troubleshooting", ["login", "sso", "scim", "session"]),
    ("pol_security_escalation", ["security", "mfa", "api_key", "lost_device"]),
    ("pol_refund", ["billing", "refund", "credit", "tax", "invoice"]),
    ("pol_data_retention", ["export", "retention", "data"]),
    ("pol_access", ["access", "permission", "admin", "invite", "oauth"]),
    ("pol_incident_response", ["incident", "outage", "sev1", "duplicate_orders"]),
]
FALLBACK_POLICY = "pol_enterprise_support"

# ---- fixed values: tokenisation ----------------------------------------------------
STOPWORDS = [
    "about", "after", "also", "and", "are", "can", "does", "for", "from", "has", "have",
    "how", "into", "is", "it", "of", "on", "or", "should", "that", "the", "this", "to",
    "what", "when", "where", "which", "who", "why", "with",
]
WORD_PATTERN = "[a-z0-9_]+"
EVAL_WORD_PATTERN = "[a-zA-Z0-9_]+"
ANALYSER_WORD_PATTERN = "[A-Za-zÀ-ỹ0-9_+-]+"
ENTITY_ID_PATTERN = "(?i)\\b(?:acct|cust|gh|msg|pol|prod|res|risk|svc|tkt)_[a-z0-9_]+\\b"

# ---- fixed values: evidence model --------------------------------------------------
NODE_TYPE_OF_SOURCE = {
    "account": "Account", "customer": "Customer", "github_issue": "GitHubIssue",
    "knowledge_base": "Policy", "policy": "Policy", "product": "Product",
    "risk_event": "RiskEvent", "service": "Service", "ticket": "Ticket",
    "ticket_message": "TicketMessage",
}
SOURCE_OF_NODE_TYPE = {
    "Account": "account", "Customer": "customer", "GitHubIssue": "github_issue",
    "Policy": "knowledge_base", "Product": "product", "RiskEvent": "risk_event",
    "Service": "service", "Team": "team", "Ticket": "ticket",
    "TicketMessage": "ticket_message",
}
SUFFICIENCY_VOCAB = [
    ("ticket", "tkt_", ["case", "escalate", "escalation", "issue", "priority", "reply", "sla",
                        "status", "ticket", "triage"]),
    ("customer", "cust_", ["account", "customer", "health", "northstar", "renewal", "summary"]),
    ("service", "svc_", ["api", "gateway", "integration", "owner", "service", "sync", "timeout"]),
    ("knowledge_base", "pol_", ["access", "policy", "refund", "retention", "runbook", "sla",
                                "troubleshooting"]),
    ("risk_event", "risk_", ["anomaly", "breach", "breached", "churn", "risk", "risky"]),
]
CONTEXT_WORDS = ["explain", "summarize", "summary", "why"]
SUFFICIENCY_WEIGHTS = {"count": 0.22, "diversity": 0.18, "entity": 0.18, "coverage": 0.25,
                       "freshness": 0.07, "contradiction": 0.15}
RISK_QUERY_WORDS = ["breach", "breached", "escalate", "escalation", "risk", "risky", "sla",
                    "severity"]
RISK_SIGNAL_WORDS = ["breach", "breached", "critical", "escalate", "escalation", "risk", "sla",
                     "severity"]
SENSITIVE_DETAILS = [
    ("credit card", "credit card details"),
    ("home address", "home address"),
    ("mobile number", "mobile number"),
    ("password value", "password value"),
    ("personal address", "personal address"),
    ("phone number", "phone number"),
    ("private phone", "private phone number"),
    ("social security", "Social Security number"),
    ("ssn", "Social Security number"),
]
MAX_USED_CITATIONS = 4
MAX_SNIPPET = 320

# ---- fixed values: question intents, allowed sources and retry expansions ----------
INTENT_RULES = [
    ("service_owner", ["owner", "owns", "team", "service_catalog"]),
    ("risk_explanation", ["risk", "risky", "anomaly", "churn", "breach", "breached", "incident"]),
    ("policy_lookup", ["policy", "policies", "runbook", "sla", "refund", "access", "retention",
                       "security", "troubleshooting"]),
    ("ticket_triage", ["triage", "priority", "severity", "escalate", "escalation"]),
    ("customer_summary", ["summary", "summarize", "customer", "account", "health", "renewal"]),
]
INTENT_SOURCES = {
    "customer_summary": ["customer", "account", "ticket", "risk_event"],
    "ticket_triage": ["ticket", "ticket_message", "knowledge_base", "service", "risk_event"],
    "policy_lookup": ["knowledge_base"],
    "service_owner": ["service", "github_issue"],
    "risk_explanation": ["risk_event", "ticket", "customer", "service"],
    "general": [],
}
INTENT_EXPANSIONS = {
    "customer_summary": "customer account ticket risk health renewal summary",
    "ticket_triage": "ticket priority status severity SLA escalation service policy",
    "policy_lookup": "knowledge base policy runbook SLA access refund security retention",
    "service_owner": "service catalog owner team engineering GitHub issue",
    "risk_explanation": "risk event anomaly escalation incident ticket customer service",
    "general": "customer ticket policy service risk evidence",
}
FILTER_FIELD_OF_PREFIX = [
    ("cust_", "customer_id"), ("tkt_", "ticket_id"), ("svc_", "service_id"),
    ("prod_", "product_id"),
]

# ---- fixed values: question routing ------------------------------------------------
MIN_QUESTION_CHARS = 8
SOURCE_LISTING_SIGNALS = [
    "cho tôi source", "cho tôi nguồn", "liệt kê tài liệu", "liệt kê source", "cho toi source",
    "cho toi nguon", "liet ke tai lieu", "liet ke source", "show source", "show sources",
    "related docs", "tài liệu liên quan", "nguồn liên quan", "tai lieu lien quan",
    "nguon lien quan", "debug retrieval",
]
DOMAIN_KEYWORDS = [
    ("github_docs", 10, ["github", "git", "passkey", "ssh", "https", "push", "pull request",
                         "repo", "repository", "actions", "workflow", "auth", "authentication"]),
    ("gitlab", 20, ["gitlab", "handbook", "policy", "process", "guideline", "onboarding",
                    "internal", "team", "approval"]),
    ("issues", 30, ["issue", "bug", "error", "lỗi", "không chạy", "workaround", "known issue",
                    "discussion", "problem"]),
]
DEFAULT_DOMAIN = "github_docs"

# ---- fixed values: query analyser --------------------------------------------------
ANALYSER_STOPWORDS = [
    "how", "what", "when", "where", "which", "with", "from", "into", "your", "have", "does",
    "this", "that", "using", "used", "about", "there", "need", "then", "than", "they", "them",
    "onto", "help", "please",
    "làm", "thế", "nào", "để", "bằng", "cách", "mình", "tôi", "có", "thể", "và", "của", "cho",
    "với", "trên", "khi", "sao", "vào", "trong", "như", "được", "một", "các", "những", "là",
    "muốn", "giúp", "lên",
]
SHORT_KEYWORDS = ["git", "ssh", "2fa"]
GENERIC_KEYWORDS = ["project", "projects", "repo", "repository", "repositories", "account",
                    "accounts", "user", "users"]
PLATFORMS = ["github", "gitlab"]
KEYWORD_EXPANSIONS = [
    ("gitbash", ["gitbash", "git bash", "bash"]),
    ("passkey", ["passkey", "passkeys"]),
    ("passkeys", ["passkey", "passkeys"]),
    ("login", ["login", "log in", "sign in", "signin", "đăng nhập"]),
    ("signin", ["sign in", "signin", "login", "log in", "đăng nhập"]),
    ("authentication", ["authentication", "authenticate", "xác thực", "2fa", "two-factor",
                        "two factor"]),
    ("manage", ["manage", "managing", "management", "quản lý"]),
    ("push", ["push"]),
    ("fork", ["fork"]),
    ("ssh", ["ssh"]),
    ("handbook", ["handbook", "cẩm nang", "sổ tay"]),
    ("policy", ["policy", "policies", "chính sách"]),
    ("support", ["support", "hỗ trợ"]),
    ("engineering", ["engineering", "kỹ thuật"]),
    ("access", ["access", "permission", "permissions", "quyền", "truy cập"]),
]
# intent label, trigger phrases, trigger keywords, added keywords, preferred, penalised, phrases
ANALYSER_INTENTS = [
    ("github_authentication",
     ["passkey", "passkeys", "login", "log in", "sign in", "signin", "đăng nhập",
      "authentication", "authenticate", "xác thực", "2fa", "two-factor", "two factor",
      "manage passkeys", "managing passkeys", "manage your passkeys", "managing your passkeys",
      "sign in with a passkey", "signing in with a passkey", "đăng nhập bằng passkey",
      "quản lý passkey", "quản lý passkeys"],
     ["passkey", "passkeys", "authentication", "login", "signin"],
     ["passkey", "passkeys", "authentication", "login", "signin", "manage", "managing"],
     ["github_docs"], ["gitlab_handbook"],
     ["passkey", "passkeys", "sign in", "sign in with a passkey", "signing in with a passkey",
      "manage your passkeys", "managing your passkeys", "authentication", "login",
      "đăng nhập", "quản lý passkey"]),
    ("gitlab_handbook",
     ["handbook", "cẩm nang", "sổ tay", "support handbook", "engineering handbook",
      "handbook policy", "policy", "policies"],
     [],
     ["handbook", "policy", "support", "engineering"],
     ["gitlab_handbook"], [],
     ["handbook", "support handbook", "engineering handbook", "policy"]),
    ("repository_access",
     ["repository access", "repo access", "repository permission", "repository permissions",
      "quyền truy cập repository", "quyền truy cập repo", "permission", "permissions",
      "access", "collaborator", "collaborators", "team access"],
     [],
     ["repository", "access", "permission", "permissions"],
     ["github_docs", "github_issues"], ["gitlab_handbook"],
     ["repository access", "permission", "permissions",
      "managing teams and people with access to your repository",
      "permission levels for a personal account repository"]),
]

# ---- fixed values: heuristic re-ranking --------------------------------------------
# keyword class -> points for a hit in title / id / content
RERANK_POINTS = {"platform": (7.0, 5.0, 2.5), "strong": (8.0, 5.0, 2.5), "weak": (2.0, 1.5, 0.8)}

# ---- fixed values: issue intake ----------------------------------------------------
ISSUE_CATEGORIES = [
    ("access_issue", ["access", "permission", "repo", "organization"]),
    ("account_issue", ["login", "account", "password", "sign in"]),
    ("network_issue", ["network", "vpn", "connection"]),
    ("software_issue", ["install", "setup", "tool", "software"]),
]
ISSUE_PRIORITIES = [
    ("high", ["urgent", "critical", "blocked", "cannot access"]),
    ("medium", ["error", "fail", "issue", "problem"]),
]
ALLOWED_DOC_PREFIXES = ["get-started", "authentication", "repositories"]
MIN_DOC_CHARS = 300
MIN_ISSUE_CHARS = 30
STATIC_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".pdf", ".zip", ".mp4", ".webm",
                     ".ico", ".css", ".js", ".woff", ".woff2", ".ttf", ".eot", ".xml"]

# ---- fixed values: chunk sizes (size, overlap, hard maximum) and separators --------
CHUNK_SIZES = {
    "github_docs": (320, 40, 350),
    "gitlab_handbook": (280, 40, 320),
    "github_issues": (220, 30, 260),
    "default": (300, 40, 320),
}
SECTION_SEPARATORS = ["\n## ", "\n### ", "\n#### ", "\n\n", "\n", ". ", " ", ""]
ISSUE_SEPARATORS = ["\n\nComments:", "\n\nComment ", "\n\nBody:", "\n\nDescription:", "\n\n",
                    "\n", ". ", " ", ""]
PLAIN_SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
LEAF_SEPARATORS = ["\n## ", "\n### ", "\n\n", "\n", ". ", " ", ""]
MIN_CHUNK_CHARS = 80
MIN_CHUNK_WORD_CHARS = 20

# ---- fixed values: redaction -------------------------------------------------------
REDACTED = "[REDACTED]"
SENSITIVE_FIELDS = ["access_token", "refresh_token", "client_secret", "api_key",
                    "authorization", "private_key_path", "private_key", "password", "secret",
                    "token", "jwt"]
SENSITIVE_KEY_PARTS = ["token", "secret", "password", "authorization", "private_key", "api_key",
                       "jwt", "credential"]

# ---- fixed values: answer clean-up -------------------------------------------------
ANSWER_PREFIXES = [
    "Dựa trên context được cung cấp,",
    "Dựa trên tài liệu được cung cấp,",
    "Theo context được cung cấp,",
    "Theo tài liệu được cung cấp,",
    "Dựa trên các nguồn được cung cấp,",
    "Theo các nguồn được cung cấp,",
]

# ---- fixed values: follow-up detection ---------------------------------------------
FOLLOW_UP_PREFIXES = ["thế còn", "còn", "ý là", "ý tôi là", "tiếp tục", "còn github",
                      "còn gitlab", "trên github", "trên gitlab", "vậy còn"]
FOLLOW_UP_MARKERS = ["nó", "đó", "cái đó", "phần đó", "cách đó", "ý đó", "phần trên", "ở trên",
                     "bên trên"]

# ---- fixed values: evaluation ------------------------------------------------------
RELEVANCE_POINTS = {"document": 3, "category": 2, "source": 1}
GATE_MIN_RECALL = 0.65
GATE_MIN_SOURCE_HIT = 0.90
QUALITY_STOPWORDS = [
    "the", "and", "with", "that", "this", "from", "your", "into", "using", "used", "have",
    "there", "need", "then", "them", "how", "what", "when", "where", "which", "for", "you",
    "are", "can", "was", "were", "does",
    "một", "những", "được", "làm", "thế", "nào", "để", "cách", "với", "trong", "khi", "cho",
    "của", "các", "là",
]
