"""Fixed values of the scoring and collection rules.

Everything here is data the results depend on: term sets, label codes, bounds
and weights.  Order matters where a comment says so.
"""

# --- windows and caps (fixed values) -------------------------------------------------
MAX_HEAT_OBSERVATIONS = 30
MIN_PERSISTENCE_WINDOW = 7
MIN_PERSISTENCE_COUNT = 5
MIN_PERSISTENCE_RATIO = 0.7
CATALOG_DEFAULT = 30
DAILY_SIZE, DAILY_LONG_TERM, DAILY_RECENT = 5, 2, 3
HITS_PER_RULE = 30
MAX_URL_LENGTH = 2_048
DISPLAY_ZONE = "Asia/Shanghai"

# --- term sets, matched as substrings of the lower-cased repository text (fixed values) ---
PRODUCTIVITY_TERMS = [
    "agent", "automation", "cli", "code", "developer", "github", "llm", "mcp",
    "productivity", "research", "sdk", "self-hosted", "tool", "video", "workflow",
    "人工智能", "公众号", "工作流", "开发", "生产力", "自动化", "视频",
]
LOW_ACTIONABILITY_TERMS = [
    "awesome", "books", "cheatsheet", "curriculum", "fundamentals", "interview", "roadmap",
]
RISK_TERMS = [
    "bypass safety", "disable safety", "disable all content filters", "exploit", "fuckclaude",
    "jailbreak", "offensive-security", "redeem only", "spoof", "unrestricted mode",
    "关闭所有内容过滤器", "关闭内容过滤", "无限制模式",
]
# First category whose terms occur wins; the last one is the default (fixed values).
CATEGORY_TERMS = [
    ("video", ["video", "视频", "douyin", "youtube", "公众号"]),
    ("ai_agent", ["agent", "mcp", "llm", "artificial-intelligence", "人工智能"]),
    ("research", ["research", "science", "evaluation", "研究"]),
    ("productivity", ["automation", "workflow", "productivity", "自动化", "工作流", "生产力"]),
    ("devtools", ["developer", "sdk", "cli", "api", "code", "开发"]),
    ("self_hosted", ["self-hosted", "selfhosted"]),
]
DEFAULT_CATEGORY = "open_source"

# --- terms and priorities of signals (fixed values) -----------------------------------
SIGNAL_AI_TERMS = [
    "agent", "ai", "claude", "codex", "copilot", "developer", "github", "gpt", "hugging face",
    "llm", "model", "open source", "人工智能", "大模型", "开源", "智能体",
]
SIGNAL_PRODUCT_TERMS = [
    "api", "available", "changelog", "copilot", "developer", "launch", "model", "now",
    "open source", "release", "update",
]
SIGNAL_MARKETING_TERMS = ["case study", "customer", "how ", "rewiring", "with ai"]
SIGNAL_KIND_PRIORITY = {"official": 4, "curated": 3, "ranking": 2, "aggregated": 1}

# --- static inspection (fixed values) -------------------------------------------------
SKIP_DIRECTORIES = [
    ".git", ".mypy_cache", ".next", ".pytest_cache", ".ruff_cache", ".tox", ".venv",
    ".wrangler", "__pycache__", "build", "coverage", "dist", "node_modules", "target", "vendor",
]
SKIP_SUFFIXES = [
    ".db", ".gif", ".gz", ".jpeg", ".jpg", ".log", ".pdf", ".png", ".pyc", ".pyo", ".sqlite",
    ".sqlite3", ".tsbuildinfo", ".woff", ".woff2",
]
TEXT_SUFFIXES = [
    ".c", ".cpp", ".css", ".go", ".html", ".java", ".js", ".jsx", ".md", ".php", ".py", ".rb",
    ".rs", ".sh", ".sql", ".ts", ".tsx", ".vue", ".yaml", ".yml",
]
INDICATORS = [
    "readme", "license", "tests", "ci", "docker", "dependency_lock", "package_manifest",
    "examples", "docs", "environment_example",
]
DOCKER_NAMES = ["dockerfile", "docker-compose.yml", "compose.yml"]
LOCK_NAMES = [
    "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "cargo.lock", "go.sum",
]
MANIFEST_NAMES = ["package.json", "pyproject.toml", "setup.py", "cargo.toml", "go.mod"]
ENV_EXAMPLE_NAMES = [".env.example", ".env.sample"]
# First signature that occurs names the licence.
LICENSE_SIGNATURES = [
    ("Apache-2.0", "apache license"),
    ("MIT", "mit license"),
    ("GPL", "gnu general public license"),
    ("BSD", "redistribution and use in source and binary forms"),
]
LICENSE_UNRECOGNISED = "license file present"
READINESS_WEIGHTS = [
    ("readme", 15), ("license", 15), ("tests", 20), ("ci", 15), ("docs", 10), ("examples", 8),
    ("package_manifest", 7), ("dependency_lock", 5),
]

# --- identity (fixed values) ----------------------------------------------------------
REPOSITORY_PATTERN = (
    r"^[A-Za-z0-9](?:[A-Za-z0-9]|-(?=[A-Za-z0-9])){0,38}/(?!\.{1,2}$)[A-Za-z0-9._-]{1,100}$"
)
PROJECT_ID_PATTERN = r"^[a-z0-9]+(?:-[a-z0-9]+)*--[0-9a-f]{20}$"
PROJECT_ID_VERSION = 1
PROJECT_ID_LENGTHS = (25, 86)

# --- actions and feedback (fixed values) ----------------------------------------------
ACTION_STAGES = ["opened", "saved", "tried", "cloned", "reused"]  # rank = position
IDEMPOTENCY_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._:-]{7,199}$"
RESERVED_KEY_PREFIX = "legacy-project-actions:"
LEGACY_MATCH_MICROS = 2_000
FEEDBACK_VALUES = ["useful", "useless", "reuse", "unsure"]
PREFERENCE_WEIGHTS = {"reuse": 2.6, "useful": 1.4, "unsure": 0.15, "useless": -1.7}
DIRECT_ADJUSTMENTS = {"reuse": -18.0, "useful": -12.0, "unsure": 2.5, "useless": -80.0}
# Features too common to say anything about taste.
GENERIC_FEATURES = [
    "open_source", "tool", "devtools", "artificial intelligence", "ai", "agent",
    "python project", "typescript project", "javascript project",
]

# --- search intents: label, trigger words, capabilities, project terms (fixed values) -
INTENT_RULES = [
    ("video_analysis",
     ["视频", "抖音", "短视频", "账号", "脚本", "流量", "字幕"],
     ["video capture", "content breakdown", "account analysis", "script writing", "traffic forecast"],
     ["video", "视频", "transcript", "douyin", "youtube", "creator", "content", "analytics"]),
    ("research_evidence",
     ["新闻", "热点", "研究", "信息", "证据", "文献", "报告"],
     ["multi-source search", "evidence summary", "research workflow", "report writing"],
     ["research", "science", "evidence", "news", "paper", "literature", "report", "研究"]),
    ("agent_engineering",
     ["agent", "智能体", "代理", "codex", "claude", "mcp", "技能"],
     ["agent tooling", "skill orchestration", "model cooperation", "session memory"],
     ["agent", "codex", "claude", "mcp", "skill", "memory", "hook", "智能体"]),
    ("document_automation",
     ["文档", "office", "表格", "excel", "ppt", "word", "公众号"],
     ["document editing", "format conversion", "content generation", "automatic layout"],
     ["document", "office", "excel", "spreadsheet", "ppt", "word", "markdown", "公众号"]),
    ("repository_intelligence",
     ["github", "开源仓库", "代码仓库", "star", "趋势排行"],
     ["repository analysis", "trend tracking", "project comparison", "code inspection"],
     ["github", "repository", "developer", "code", "open source", "trend", "analysis"]),
    ("process_automation",
     ["自动", "流程", "工作流", "批量", "任务", "定时"],
     ["process orchestration", "batch execution", "task automation", "run monitoring"],
     ["automation", "workflow", "pipeline", "scheduler", "task", "自动化", "工作流"]),
    ("service_integration",
     ["oauth", "登录", "gmail", "notion", "slack", "api", "第三方", "连接器"],
     ["oauth", "credential management", "api integration", "connector gateway"],
     ["oauth", "connector", "api gateway", "credential", "integration", "saas", "openapi"]),
    ("knowledge_graph",
     ["知识库", "知识图谱", "能力图谱", "学习路径", "依赖关系", "课程"],
     ["knowledge graph", "capability breakdown", "dependency relations", "evidence standard"],
     ["taxonomy", "knowledge graph", "prerequisite", "curriculum", "graph", "知识图谱"]),
]
DEFAULT_CAPABILITIES = ["need understanding", "similar projects", "reusable modules"]
