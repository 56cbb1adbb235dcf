"""Word lists, patterns, limits and profiles that results depend on.

They are data, not logic. Every list keeps its natural order because several
operators take the first entry that applies.
"""

# --- source and content types -------------------------------------------------
WIKI = "confluence"
TRACKER = "jira"
ISSUE_TYPE = "jira_issue"
PROJECT_SUMMARY_TYPE = "jira_project_status_summary"
SCOPE_SUMMARY_TYPE = "jira_mention_scope_summary"

# --- question analysis ----------------------------------------------------------
STOP_WORDS = [
    "관련", "문서", "요약", "내용", "정리", "알려줘", "찾아줘",
    "요약해", "요약해줘", "해줘", "주간보고",
]
PARTICLES = ["에게서", "에게", "으로", "에서", "부터", "까지", "은", "는", "이", "가", "을", "를", "의"]
SYNONYMS = {
    "기술회의": ["기술회의", "주간회의", "회의록", "회의"],
    "주간회의": ["주간회의", "기술회의", "회의록", "회의"],
    "회의록": ["회의록", "회의", "기술회의", "주간회의"],
    "점검": ["점검", "정기점검", "유지보수"],
    "정기점검": ["정기점검", "점검", "유지보수"],
    "해야할일": ["해야할일", "todo", "pending", "open"],
    "진행중": ["진행중", "inprogress", "현재"],
    "완료": ["완료", "done", "closed", "resolved"],
    "사내": ["사내", "전사", "회사", "내부"],
    "전사": ["전사", "사내", "회사", "내부"],
    "규정": ["규정", "정책"],
}
STATUS_TERMS = {
    "todo": ["todo", "to do", "pending", "open", "해야", "할일", "예정", "대기"],
    "in_progress": ["inprogress", "in progress", "진행", "진행중", "작업중", "현재"],
    "done": ["done", "closed", "resolved", "완료", "끝난", "종료"],
}
STATUS_INTENT_TERMS = [
    "jira", "이슈", "issue", "프로젝트", "진행", "진행중", "해야", "완료", "todo", "done", "현재",
]
STATUS_QUERY_TERMS = ["jira", "이슈", "issue", "진행", "진행중", "해야", "완료", "todo", "done", "현재"]

# Categories asked for in an issue summary; PAST_ACTIVITY words stop the bare fallback.
SUMMARY_STATUS_TERMS = {
    "todo": ["진행예정", "예정", "해야", "할일", "todo", "pending", "open"],
    "in_progress": ["진행중", "작업중", "inprogress"],
    "done": ["완료", "종료", "done", "closed", "resolved"],
}
PAST_ACTIVITY_TERMS = ["진행했던", "진행한", "했던", "수행한"]
BARE_PROGRESS_TERM = "진행"

# Category read from a status text, in the order the rules are tried.
INFERRED_STATUS_TERMS = [
    ("done", ["완료", "done", "closed", "resolved"]),
    ("todo", ["해야", "할일", "todo", "pending", "open"]),
    ("in_progress", ["진행", "inprogress"]),
]
MAINTENANCE_CHECK = "점검"
MAINTENANCE_QUERY_TERMS = ["유지보수", "maintenance"]
MAINTENANCE_NAME_TERMS = ["maintenance", "maint"]
TRACKER_QUERY_TERMS = ["jira", "이슈", "issue"]
TECH_MEETING = "기술회의"

# --- patterns -------------------------------------------------------------------
ISSUE_KEY = r"\b[A-Z][A-Z0-9]+-[0-9]+\b"
HANGUL_RUN = r"([가-힣]{2,12})"
MONTH_WORD = r"(?<![0-9])(1[0-2]|0?[1-9])\s*월"
YEAR_MONTH = r"\b(?:20)?[0-9]{2}[-_.](1[0-2]|0[1-9])\b"
LOCATOR_COMPACT = r"(?<![0-9])(?:[0-9]{2})?(0[1-9]|1[0-2])(?:[0-3][0-9])(?![0-9])"
LOCATOR_COMPACT_DAY = r"(?<![0-9])(?:[0-9]{2})?(0[1-9]|1[0-2])([0-3][0-9])(?![0-9])"
LOCATOR_SEPARATED = r"\b(?:20)?[0-9]{2}[-_.](1[0-2]|0[1-9])(?:[-_.][0-9]{1,2})?\b"
LOCATOR_SEPARATED_DAY = r"\b(?:20)?[0-9]{2}[-_.](1[0-2]|0[1-9])[-_.]([0-9]{1,2})\b"
DATE_KOREAN = r"(20[0-9]{2}|[0-9]{2})\s*년\s*([0-9]{1,2})\s*월\s*([0-9]{1,2})\s*일(?:자)?"
DATE_SEPARATED = r"\b(20[0-9]{2}|[0-9]{2})[-_.]([0-9]{1,2})[-_.]([0-9]{1,2})\b"
DATE_MONTH_DAY = r"(?<![0-9])([0-9]{1,2})\s*월\s*([0-9]{1,2})\s*일(?:자)?"
DATE_COMPACT = r"(?<![0-9])(0[1-9]|1[0-2])([0-3][0-9])(?![0-9])"
WEEK_FULL = r"(?i)(20[0-9]{2}|[0-9]{2})[-_.\s년월]+([0-9]{1,2})[-_.\s월]+([0-9]{1,2})\s*(?:주차|w)"
WEEK_MONTH = r"([0-9]{1,2})\s*월\s*([0-9]{1,2})\s*주차"
MENTION_TOKEN = r"@([^\s@]+)"
GENERAL_TERM = r"([0-9A-Za-z가-힣]+)"
FIELD_DATE = r"\b20[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}\b|\b[0-9]{1,2}월\s*[0-9]{1,2}일\b"
FIELD_DATE_NAMES = ["date", "날짜", "일자", "일시", "점검일"]
ISSUE_DATE_MONTH = r"\b(?:20)?[0-9]{2}[-_.](1[0-2]|0[1-9])[-_.][0-9]{1,2}\b"
ISSUE_TITLE_MONTH = r"\b[0-9]{2}[-_.](1[0-2]|0[1-9])\b"
PROJECT_LINK = r"/projects/([A-Z][A-Z0-9]+)(?:/|$)"
HISTORY_SOURCE_LINE = r"(?i)^(출처|참고|제공된|Sources?|Reference)"

# --- routes -----------------------------------------------------------------------
ROUTE_TRACKER_SCOPE = ["jira", "issue", "이슈", "작업", "maintenance"]
ROUTE_STATUS = ["진행", "예정", "완료", "해야", "todo", "done", "status", "상태"]
ROUTE_WHOLE_DOCUMENT = ["문서전체", "전체문서"]
ROUTE_SUMMARY = ["요약", "정리", "summary"]
ROUTE_DOCUMENT = ["문서", "document"]
ROUTE_DETAIL = ["자세히", "상세", "전체내용", "detail"]
ROUTE_LOOKUP = ["규정", "접속정보", "주소", "계정", "일정", "날짜", "값", "번호", "ip", "url", "서버", "포트"]
ROUTE_TEMPORAL = [r"[0-9]+\s*주차\s*(?:[~-]|부터)\s*[0-9]+\s*주차", r"[1234]\s*분기", r"상반기|하반기"]
ROUTE_PROJECT = ["프로젝트", "project"]
ROUTE_OVERVIEW = ["현황", "개요", "진행", "overview"]
ROUTE_BROAD = ["관련문서", "찾아", "검색", "explore"]

PROFILE_FIELDS = [
    "vector_top_k", "keyword_top_k", "jira_top_k", "expand_chunks", "max_context_chars",
    "long_doc_neighbor_window", "long_doc_detail_chunks", "long_doc_summary_window_chunks",
]
PROFILES = {
    "exact_lookup": (4, 6, 5, 12, 12000, 4, 48, 8, False),
    "single_doc_detail": (4, 6, 5, 32, 24000, 4, 48, 8, False),
    "multi_doc_summary": (8, 6, 5, 12, 36000, 4, 48, 8, False),
    "jira_status_summary": (4, 4, 8, 8, 18000, 4, 48, 8, False),
    "project_overview": (8, 6, 8, 16, 24000, 4, 48, 8, False),
    "broad_exploration": (12, 8, 5, 8, 18000, 4, 48, 8, False),
    "long_doc_lookup": (4, 8, 5, 8, 18000, 4, 48, 8, False),
    "long_doc_detail": (4, 8, 5, 48, 36000, 4, 48, 8, False),
    "long_doc_summary": (4, 6, 5, 8, 24000, 4, 48, 8, True),
    "fallback": (5, 3, 5, 20, 18000, 4, 48, 8, False),
}

# --- time buckets -----------------------------------------------------------------
QUARTER = r"([1-4])\s*분기"
HALF_YEARS = {"상반기": (1, 6), "하반기": (7, 12)}
WEEK_RANGES = [
    r"([1-5])\s*주차\s*[~\-]\s*([1-5])\s*주차",
    r"([1-5])\s*주차\s*(?:부터|에서)\s*([1-5])\s*주차\s*까지",
    r"([1-5])\s*[~\-]\s*([1-5])\s*주차",
]
SINGLE_BUCKET = "single"

# --- follow-up anchors ---------------------------------------------------------------
DOCUMENT_TYPES = ["주간보고", "회의록", "기술회의", "점검", "프로젝트", "이슈"]
SUBJECT_STOP_WORDS = [
    "보고서", "문서", "회의록", "기술회의", "주간보고", "주차",
    "프로젝트", "이슈", "점검", "내용", "이번주", "지난주",
]
SUBJECT_PATTERNS = [
    r"([가-힣]{2,4})\s*의",
    r"([가-힣]{2,4})\s+것(?:도|으로)(?:\s|$)",
    r"([가-힣]{2,4})\s*주간보고",
    r"^([가-힣]{2,4})\s+(?=(?:20[0-9]{2}\s*년|[0-9]{1,2}\s*월|[0-9]\s*주차|주간보고|회의록|기술회의|점검|프로젝트|이슈))",
]
ANCHOR_YEAR = r"(20[0-9]{2})\s*년"
ANCHOR_MONTH = [
    MONTH_WORD,
    r"(?:20)?[0-9]{2}[-_.년\s]+(1[0-2]|0?[1-9])[-_.월\s]+[0-9]{1,2}\s*주차",
]
ANCHOR_WEEK = [
    r"(?<![0-9])([1-5])\s*주차",
    r"(?:20)?[0-9]{2}[-_.년\s]+(?:1[0-2]|0?[1-9])[-_.월\s]+(0?[1-5])\s*주차",
]

# --- reuse of earlier sources ------------------------------------------------------------
REFERENCE_MARKERS = ["그거", "그것", "위내용", "방금", "아까", "이내용", "해당내용", "앞서", "이전"]
EXPANSION_MARKERS = ["다른", "나머지", "그외", "추가로", "또"]
STANDALONE_PERIOD = r"[0-9]{2,4}\s*년|[0-9]{1,2}\s*월|[0-9]{1,2}\s*주차|[0-9]{2}-[0-9]{2}"
STANDALONE_DOMAIN = ["주간보고", "회의록", "프로젝트", "이슈", "문서", "점검", "서버", "목록", "정보"]
STANDALONE_NAME = r"(?<![가-힣])[가-힣]{2,4}(?:님|의|이야|은|는|팀장|팀원)?"
SHORT_QUESTION_CHARS = 20

# --- limits -----------------------------------------------------------------------------------
HISTORY_TURNS = 8
HISTORY_MAX_CHARS = 4000
HISTORY_USER_CHARS = 700
HISTORY_ASSISTANT_CHARS = 900
HINT_MAX_CHARS = 1000
NO_HISTORY_HINT = "No prior conversation context."
PRIOR_SOURCE_LIMIT = 4
PRIOR_SOURCE_CHUNKS = 12
CLIENT_SOURCE_LIMIT = 6
KEYWORD_TOP_K = 3
STATUS_TOP_K = 5
VECTOR_TOP_K = 5
CHUNK_CHARS = 800
CHUNK_OVERLAP = 150
CHUNK_SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
TABLE_CHUNK_CHARS = 6000
LONG_DOCUMENT_CHUNKS = 21
MAX_ISSUES = 1000
MAX_COMMENTS = 20
CUSTOM_FIELD_CHARS = 500
BM25_K1 = 1.2
BM25_B = 0.75
IDF_FLOOR = 0.1
RRF_K = 60
CONTEXT_SEPARATOR = "\n\n---\n\n"
CONTEXT_BUDGETS = [4000, 8000, 12000, 18000, 32768]
LOG_RETENTION_DAYS = 30
