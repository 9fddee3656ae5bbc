"""Fixed values.

Everything in this module is a plain value that results depend on: thresholds,
word lists, patterns, code tables and standing texts. There is no logic here.
"""

# --- Fixed values: limits and rates --------------------------------------------------

PAYMENT_LIMIT_DAYS = 45
PAYMENT_NOTICE_DAYS = 7
ITC_NOTICE_DAYS = 30
LARGE_AMOUNT = 1_000_000_000
TAX_TOLERANCE = 1
INVOICE_NO_MAX = 16
RATE_TOLERANCE = "0.5"
SLAB_RATES = [0, 5, 12, 18, 28]
FORECAST_MONTHS = 3
VENDOR_BASE_SCORE = 50
VENDOR_SCORE_STEP = 5
VENDOR_SCORE_MAX = 100
VENDOR_RISK_SCORE = 60
VENDOR_MIN_HISTORY = 3
VENDOR_TOP = 20
MAJOR_VENDOR_VALUE = 100_000
RECOMMENDATION_CAP = 10
NULLS_WORTH_REPORTING = 10
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
NEAREST_DEFAULT = 5
UPLOAD_LIMIT_BYTES = 50 * 1024 * 1024
UPLOAD_EXTENSIONS = [".xlsx", ".xls", ".csv"]
PROMPT_MAX_CHARS = 5000
SQL_MAX_CHARS = 10000
SQL_ROW_CAP = 20
TENANT_ID_MAX = 50
RESERVED_TENANTS = ["test", "admin", "system", "default"]
HEADER_SCAN_LINES = 30

# --- Fixed values: code tables -------------------------------------------------------

STATES = [
    ("01", "Jammu & Kashmir", "UT", "North"),
    ("02", "Himachal Pradesh", "State", "North"),
    ("03", "Punjab", "State", "North"),
    ("04", "Chandigarh", "UT", "North"),
    ("05", "Uttarakhand", "State", "North"),
    ("06", "Haryana", "State", "North"),
    ("07", "Delhi", "UT", "North"),
    ("08", "Rajasthan", "State", "North"),
    ("09", "Uttar Pradesh", "State", "North"),
    ("10", "Bihar", "State", "East"),
    ("11", "Sikkim", "State", "Northeast"),
    ("12", "Arunachal Pradesh", "State", "Northeast"),
    ("13", "Nagaland", "State", "Northeast"),
    ("14", "Manipur", "State", "Northeast"),
    ("15", "Mizoram", "State", "Northeast"),
    ("16", "Tripura", "State", "Northeast"),
    ("17", "Meghalaya", "State", "Northeast"),
    ("18", "Assam", "State", "Northeast"),
    ("19", "West Bengal", "State", "East"),
    ("20", "Jharkhand", "State", "East"),
    ("21", "Odisha", "State", "East"),
    ("22", "Chhattisgarh", "State", "Central"),
    ("23", "Madhya Pradesh", "State", "Central"),
    ("24", "Gujarat", "State", "West"),
    ("26", "Dadra & Nagar Haveli and Daman & Diu", "UT", "West"),
    ("27", "Maharashtra", "State", "West"),
    ("28", "Andhra Pradesh (Old)", "State", "South"),
    ("29", "Karnataka", "State", "South"),
    ("30", "Goa", "State", "West"),
    ("31", "Lakshadweep", "UT", "South"),
    ("32", "Kerala", "State", "South"),
    ("33", "Tamil Nadu", "State", "South"),
    ("34", "Puducherry", "UT", "South"),
    ("35", "Andaman & Nicobar Islands", "UT", "South"),
    ("36", "Telangana", "State", "South"),
    ("37", "Andhra Pradesh", "State", "South"),
    ("97", "Other Territory", "Other", "Other"),
    ("99", "Centre Jurisdiction", "Other", "Other"),
]

# band, turnover limit in rupees, investment limit in rupees
MSME_BANDS = [
    ("micro", 50_000_000, 10_000_000),
    ("small", 500_000_000, 100_000_000),
    ("medium", 2_500_000_000, 500_000_000),
]

# slab, rate, examples
SLABS = [
    ("exempt", 0, "Fresh milk; Education; Healthcare"),
    ("merit", 5, "Packaged food; Economy hotels; Transport"),
    ("standard", 18, "Most goods; Restaurants; IT services"),
    ("luxury", 28, "Luxury cars; Tobacco; Aerated drinks"),
]

# Section 17(5) items
BLOCKED_ITEMS = [
    "Motor Vehicles and Conveyances",
    "Food and Beverages",
    "Outdoor Catering",
    "Beauty Treatment",
    "Health Services",
    "Cosmetic/Plastic Surgery",
    "Club/Health/Fitness Membership",
    "Rent-a-Cab/Life Insurance/Health Insurance",
    "Travel Benefits to Employees",
    "Works Contract for Construction of Immovable Property",
    "Goods/Services for Construction of Immovable Property",
    "Goods/Services received by Non-Resident Taxable Person",
    "Goods/Services used for Personal Consumption",
    "Goods Lost/Stolen/Destroyed/Written Off/Disposed as Gift",
    "Tax Paid under Section 74/129/130",
]

BLOCKED_KEYWORD_GROUPS = [
    ("food", "beverages", "catering"),
    ("club", "membership"),
    ("motor", "vehicle"),
    ("health", "services"),
    ("travel", "benefits"),
]

COMPLIANCE_RULES = {
    "payment_rule": "Payment to MSMEs within 45 days",
    "payment_penalty": "Disallowance of expense deduction",
    "blocked_rule": "Blocked Input Tax Credit",
    "itc_rule": "ITC claim deadline",
    "itc_deadline": "30th November of following FY or annual return, whichever earlier",
}

# A small card of our own: position, code, item, category, rate, cess.
# The single words are items of the test ledgers; the rest follow public notifications.
GOODS_CARD = [
    (1, "0401", "Fresh Milk", "dairy", "0", "0"),
    (2, "0713", "Pulses", "food", "0", "0"),
    (3, "1006", "Branded Rice", "food", "5", "0"),
    (4, "2202", "Aerated Drinks", "beverage", "28", "12"),
    (5, "2402", "Cigarettes", "tobacco", "28", "variable"),
    (6, "3401", "Soap", "personal care", "5", "0"),
    (7, "7102", "Rough Diamonds", "gems", "0.25", "0"),
    (8, "72-73", "Iron and Steel Articles", "metal", "18", "0"),
    (9, "8432-8436", "Agricultural Machinery", "machinery", "5", "0"),
    (10, "8471", "Laptop", "electronics", "18", "0"),
    (11, "8517", "Mobile Phone", "electronics", "18", "0"),
    (12, "8703", "Luxury Car", "vehicle", "28", "22"),
    (13, "7326", "Anvil", "metal", "0", "0"),
    (14, "7318", "Bolt", "metal", "5", "0"),
    (15, "8483", "Gear", "machinery", "5", "0"),
    (16, "9503", "Gizmo", "toys", "12", "0"),
    (17, "7208", "Plate", "metal", "3", "0"),
    (18, "7113", "Ring", "jewellery", "3", "0"),
    (19, "7214", "Rod", "metal", "5", "0"),
    (20, "3926", "Widget", "plastics", "18", "0"),
]

# position, code, service, category, rate, condition
SERVICES_CARD = [
    (1, "9992", "Education", "education", "0", "Recognised institutions"),
    (2, "9993", "Healthcare", "healthcare", "0", "Clinical establishments"),
    (3, "9963", "Restaurant", "hospitality", "5", "Without input tax credit"),
    (4, "9965", "Goods Transport", "transport", "5", ""),
    (5, "9983", "Software Consulting", "professional", "18", ""),
    (6, "9954", "Construction", "works", "18", ""),
    (7, "9987", "Gear Repair", "maintenance", "18", ""),
]

# --- Fixed values: candidate column names per role -----------------------------------

ROLES = {
    "description": ["description", "item", "particulars", "narration"],
    "rate": ["cgst_rate", "tax_rate", "gst_rate"],
    "taxable": ["taxable_value", "taxable_amount", "base_amount"],
    "invoice_date": ["invoice_date", "bill_date", "date"],
    "total": ["total_value", "total_amount", "bill_amount", "amount"],
    "vendor": ["vendor", "party_name", "supplier", "vendor_name", "supplier_name"],
    "tax_amount": ["cgst_amount", "tax_amount", "gst_amount"],
    "product": ["description", "item", "product", "particulars"],
}
HALF_RATE_COLUMNS = ["cgst_rate", "cgst_amount"]

GENERIC_COLUMNS = ["id", "date", "created_at", "updated_at", "month", "year"]
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
WANT_ALL_WORDS = [
    "all ", "total", "entire", "complete", "overall", "combined",
    "across all", "sum of all", "everything",
]
ITC_CONCEPTS = [
    "cgst", "sgst", "igst", "utgst", "gst", "cess",
    "input tax credit", "itc", "reverse charge", "rcm",
    "composition scheme", "e-way bill", "e-invoice",
    "place of supply", "time of supply", "value of supply",
    "taxable person", "exempt supply", "nil rated",
    "zero rated", "composite supply", "mixed supply",
    "intra-state", "inter-state", "import", "export",
]
TAX_WORDS = ["gst", "tax", "invoice", "return", "credit"]

# --- Fixed values: formats -----------------------------------------------------------

GSTIN_FORMAT = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[A-Z0-9]{1}Z[A-Z0-9]{1}$"
INVOICE_NO_FORMAT = r"^[A-Za-z0-9/-]+$"
FAMILY_SUFFIX = r"^(.+?)_?(\d{4}[-_]?\d{2}|\d{2,4})$"
FAMILY_NUMBER = r"^(.+?)_\d+$"

# --- Fixed values: answer checks -----------------------------------------------------

ARITHMETIC_PATTERNS = [
    r"\d+\s*[\+\-\*\/]\s*\d+\s*=",
    r"=\s*₹?\s*[\d,]+",
    r"total(?:s|ing)?\s*(?:to|=|is)\s*₹?\s*[\d,]+",
    r"sum\s*(?:of|=|is)\s*₹?\s*[\d,]+",
]
RULE_WORDS = ["section", "rule", "act", "notification", "circular", "gst"]
CITATION_PATTERNS = [
    r"section\s+\d+",
    r"rule\s+\d+",
    r"notification\s+\d+",
    r"circular\s+\d+",
]
COP_OUTS = ["i don't know", "i cannot", "i'm not sure", "unable to"]
SOURCE_WORDS = ["section", "rule", "act", "cgst", "notification"]

# --- Fixed values: question classes --------------------------------------------------

DATA_QUESTION_PATTERNS = [
    r"(?:my|our) (?:total|sales|purchases|revenue|expenses)",
    r"(?:show|list|get) (?:my|our|all)",
    r"how (?:much|many) (?:did|do) (?:i|we)",
    r"(?:last|this) (?:month|quarter|year)",
]
RATE_QUESTION_PATTERNS = [
    r"(?:gst|tax) (?:rate|%) (?:on|for|of) (.+?)(?:\?|$)",
    r"(?:what|how much) (?:is the )?(?:gst|tax) on (.+?)(?:\?|$)",
    r"(.+?) (?:gst|tax) rate",
    r"rate (?:for|of|on) (.+?)(?:\?|$)",
]
CODE_QUESTION_PATTERNS = [
    r"hsn (?:code|number)? (?:for|of) (.+?)(?:\?|$)",
    r"sac (?:code|number)? (?:for|of) (.+?)(?:\?|$)",
    r"(.+?) hsn (?:code)?",
    r"(.+?) sac (?:code)?",
]
LEGAL_QUESTION_PATTERNS = [
    r"section \d+",
    r"rule \d+",
    r"can i claim",
    r"(?:is|are) .+ (?:allowed|eligible|applicable)",
    r"(?:itc|input tax credit) (?:on|for|eligibility)",
    r"blocked credit",
    r"time limit",
    r"penalty",
    r"(?:gstr|return) filing",
    r"due date for (?:filing|gstr)",
]
DEFINITION_QUESTION_PATTERNS = [
    r"what (?:is|are|does)(?: a| an| the)? (.+?)(?:\?|$)",
    r"(?:explain|define|describe)(?: (?:what|the))? (.+?)(?:\?|$)",
    r"(?:tell me about|what do you mean by) (.+?)(?:\?|$)",
    r"how (?:does|do) (.+?) work",
    r"meaning of (.+?)(?:\?|$)",
]

# words without which the pattern at the same place cannot match
RATE_QUESTION_WORDS = ["rate|%", "gst|tax", "gst rate|tax rate", "rate"]
CODE_QUESTION_WORDS = ["hsn", "sac", " hsn ", " sac "]
DEFINITION_QUESTION_WORDS = ["what", "explain|define|describe", "tell me about|what do you mean by", "how", "meaning of"]
LEGAL_QUESTION_WORDS = [
    "section", "rule", "can i claim", "allowed|eligible|applicable", "itc|input tax credit",
    "blocked credit", "time limit", "penalty", "filing", "due date",
]

# where the answer to a question comes from
SOURCE_OF_DATA = "duckdb"
SOURCE_OF_RATES = "csv"
SOURCE_OF_RULES = "chromadb"
SOURCE_OF_TERMS = "llm"

# --- Fixed values: intents -----------------------------------------------------------

INTENT_PATTERNS = [
    ("folder_analysis", [
        r"analyze\s+(?:folder|directory|path|files?)\s*[:\s]*(.+)",
        r"load\s+(?:folder|directory|files?)\s*[:\s]*(.+)",
        r"scan\s+(.+)",
        r"process\s+(?:folder|directory)\s*[:\s]*(.+)",
    ]),
    ("data_query", [
        r"(?:what(?:'s| is)|show|get|find|list)\s+(?:my|our)\s+(.+)",
        r"(?:total|sum|count|average)\s+(?:of\s+)?(?:my|our)?\s*(.+)",
        r"(?:how much|how many)\s+(.+)",
        r"(?:show|list|get)\s+(?:all\s+)?(?:sales|purchases|invoices|transactions|vendors|balance|bank|entries)",
        r"(?:what is|what's)\s+(?:the\s+)?(?:latest|current|last|final)\s+(?:balance|entry|transaction)",
        r"(?:show|get|list)\s+(?:last|latest|recent)\s+\d*\s*(?:entries|transactions|records|rows)",
        r"(?:balance|entries|transactions|records)\s+(?:for|in|from)\s+(.+)",
    ]),
    ("compliance_check", [
        r"(?:run|check|audit|verify)\s+compliance",
        r"(?:check|find)\s+(?:issues?|problems?|errors?)",
        r"compliance\s+(?:check|audit|report)",
        r"(?:check|verify)\s+(?:gst|tax|itc)",
    ]),
    ("strategic_analysis", [
        r"(?:analyze|rank|list)\s+vendors?",
        r"(?:forecast|predict)\s+(?:cash\s*flow|revenue|expenses?)",
        r"strategic\s+(?:analysis|report)",
        r"(?:profit|margin)\s+analysis",
    ]),
    ("multi_step_analysis", [
        r"(?:full|complete|comprehensive|detailed)\s+(?:analysis|report|review)",
        r"(?:analyze|review)\s+(?:everything|all)",
        r"(?:generate|create|make)\s+(?:a\s+)?(?:full|complete|comprehensive)?\s*report",
        r"(?:analyze|review).+(?:and|then)\s+(?:suggest|recommend|create|generate)",
        r"(?:deep|thorough)\s+(?:dive|analysis|review)",
        r"(?:business|financial)\s+(?:health|overview|summary)\s+report",
    ]),
    ("knowledge_query", [
        r"(?:what|explain|describe|define)\s+(?:is|are|does)\s+(.+)",
        r"(?:section|rule|act)\s+\d+",
        r"(?:gst|cgst|sgst|igst|itc)\s+(?:rule|section|law)",
        r"(?:can i|is it allowed|eligible)",
        r"(?:when|what|how)\s+(?:should|do|to)\s+(?:i|we)?\s*(?:file|fill|submit)\s+(?:gst|gstr|return)",
        r"(?:due date|deadline|last date)\s+(?:for|of|to)\s+(?:filing|gstr|gst|return)",
        r"gstr-?\d+[a-z]?\s+(?:due|deadline|filing|date)",
    ]),
    ("help", [
        r"^help$",
        r"^what can you do",
        r"^commands?$",
    ]),
]
# words without which the pattern at the same place cannot match
INTENT_PATTERN_WORDS = [
    "analyze", "load", "scan", "process",
    "my|our", "total|sum|count|average", "how much|how many", "show|list|get", "what", "last|latest|recent",
    "balance|entries|transactions|records",
    "compliance", "check|find", "compliance", "gst|tax|itc",
    "vendor", "forecast|predict", "strategic", "analysis",
    "analysis|report|review", "everything|all", "report", "suggest|recommend|create|generate", "deep|thorough", "report",
    "what|explain|describe|define", "section|rule|act", "rule|section|law", "can i|is it allowed|eligible", "gst|return",
    "due date|deadline|last date", "gstr",
    "help", "what can you do", "command",
]
INTENT_DATA_WORDS = [
    "balance", "entries", "transactions", "invoices", "sales",
    "purchases", "vendors", "bank", "ledger", "records", "rows",
    "latest", "last", "recent", "total", "sum", "average", "count",
]
INTENT_OWN_WORDS = ["my", "our", "show", "list", "get"]
INTENT_EXPLAIN_WORDS = ["explain", "section", "rule", "definition", "meaning"]
INTENT_WHAT_WORDS = ["what is", "what's"]
INTENT_TAX_WORDS = ["gst", "cgst", "sgst", "igst", "itc", "tax"]

# trigger words, then the terms appended to a retrieval query
QUERY_EXPANSIONS = [
    (["file", "fill", "submit", "return"],
     "GSTR-1 GSTR-3B form furnish due date section 39"),
    (["due date", "deadline", "when"],
     "11th 13th 20th 22nd day of month succeeding"),
    (["itc", "input tax credit"],
     "section 16 section 17 eligible blocked"),
    (["43b", "msme", "payment"],
     "45 days micro small enterprise deduction"),
]

# --- Fixed values: screening patterns ------------------------------------------------

# Each list of words stands beside its patterns: without the word (or one of the words,
# lower case) the pattern at the same place cannot match.

OVERRIDE_PATTERNS = [
    r"ignore\s+(all\s+)?(previous|prior|above|your|my|the|these)?\s*(instructions?|prompts?|rules?|guidelines?)",
    r"disregard\s+(all\s+)?(previous|prior|above|your|the)?\s*(instructions?|prompts?|rules?)",
    r"forget\s+(all\s+)?(previous|prior|above|your|the)?\s*(instructions?|prompts?|rules?)",
    r"override\s+(system|previous|all|your|the)?\s*(prompts?|instructions?|rules?)",
    r"new\s+(instructions?|rules?)\s*:",
    r"system\s*:\s*you\s+(are|will|must|should)",
    r"from\s+now\s+on\s*,?\s*(you|ignore|forget)",
    r"ignore\s+(everything|all)\s+(above|before|else)",
    r"you\s+are\s+(now|actually)\s+(a|an)\s+",
    r"act\s+as\s+(if\s+you\s+are|a|an)\s+",
    r"pretend\s+(to\s+be|you\s+are)\s+",
    r"roleplay\s+as\s+",
    r"switch\s+(to|your)\s+(role|persona)",
    r"\bDAN\b\s*(mode)?",
    r"jailbreak",
    r"bypass\s+(safety|filter|restriction)",
    r"unlock\s+(capabilities|hidden\s+mode)",
    r"developer\s+mode\s+(enabled|on)",
    r"sudo\s+mode",
    r"admin\s+mode",
    r"do\s+not\s+follow\s+(your|the|any)\s+(rules?|instructions?)",
    r"stop\s+being\s+(an?\s+)?(ai|assistant|helpful)",
]
OVERRIDE_WORDS = [
    "ignore", "disregard", "forget", "override", "new", "system", "from", "ignore",
    "you", "act", "pretend", "roleplay", "switch",
    "dan", "jailbreak", "bypass", "unlock", "developer", "sudo", "admin", "follow", "stop",
]
LEAK_PATTERNS = [
    r"(show|reveal|display|print|output|repeat)\s+(your\s+)?(system\s+)?(prompt|instructions?)",
    r"what\s+(are|is)\s+your\s+(system\s+)?(prompt|instructions?)",
    r"(tell|show)\s+me\s+(your\s+)?(initial|system)\s+(prompt|instructions?)",
    r"(paste|copy|echo)\s+(your\s+)?instructions?",
    r"above\s+(instructions?|text|prompt)\s+verbatim",
    r"beginning\s+of\s+(this\s+)?(conversation|prompt)",
]
LEAK_WORDS = ["prompt|instruction", "your", "me", "instruction", "verbatim", "beginning"]
ENCODING_PATTERNS = [
    r"\\x[0-9a-fA-F]{2}",
    r"\\u[0-9a-fA-F]{4}",
    r"&#x?[0-9a-fA-F]+;",
    r"%[0-9a-fA-F]{2}",
    r"base64\s*:",
    r"\[char\s*\d+\]",
]
ENCODING_WORDS = ["\\x", "\\u", "&#", "%", "base64", "[char"]
ENCODING_ALLOWED = 3
DELIMITER_PATTERNS = [
    r"```\s*(system|assistant|user|human)",
    r"\[INST\]",
    r"\[/INST\]",
    r"<\|im_start\|>",
    r"<\|im_end\|>",
    r"<\|system\|>",
    r"<\|user\|>",
    r"<\|assistant\|>",
    r"<<SYS>>",
    r"<</SYS>>",
    r"\[SYSTEM\]",
    r"###\s*(System|User|Assistant|Human)\s*:",
]
DELIMITER_WORDS = [
    "```", "[inst]", "[/inst]", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<<sys>>", "<</sys>>", "[system]", "###",
]
CONTEXT_PATTERNS = [
    r"(previous|above)\s+(response|output|answer)\s+was\s+(wrong|incorrect)",
    r"actually\s*,?\s+the\s+(correct|right)\s+(answer|response)",
    r"correction\s*:\s*your\s+(previous|last)",
    r"let\s+me\s+correct\s+you",
    r"that\s+was\s+a\s+test",
    r"training\s+mode\s+(on|enabled)",
]
CONTEXT_WORDS = ["was", "actually", "correction", "correct", "test", "training"]
REMOVED_DELIMITERS = [
    r"\[INST\]",
    r"\[/INST\]",
    r"<\|im_start\|>",
    r"<\|im_end\|>",
    r"<\|system\|>",
    r"<\|user\|>",
    r"<\|assistant\|>",
    r"<<SYS>>",
    r"<</SYS>>",
]
SQL_DANGER_PATTERNS = [
    r"\b(DROP|DELETE|TRUNCATE|ALTER|CREATE|INSERT|UPDATE|REPLACE)\b",
    r"\b(GRANT|REVOKE|DENY)\b",
    r"\b(EXEC|EXECUTE|CALL|INVOKE)\b",
    r"\bxp_\w+",
    r"\bsp_\w+",
    r"\b(LOAD_FILE|INTO\s+OUTFILE|INTO\s+DUMPFILE)\b",
    r"\bREAD_FILE\b",
    r"\bWRITE_FILE\b",
    r"\bSYSTEM\s*\(",
    r"\bSHELL\s*\(",
    r"\bCMD\s*\(",
    r"INFORMATION_SCHEMA",
    r"pg_catalog",
    r"sqlite_master",
    r"sys\.tables",
    r"duckdb_\w+\(\)",
    r"--\s*$",
    r"/\*.*\*/",
    r";\s*--",
    r"UNION\s+(ALL\s+)?SELECT\s+NULL",
    r"UNION\s+(ALL\s+)?SELECT\s+\d+",
    r"'\s*(OR|AND)\s+'?\d+'\s*=\s*'?\d+",
    r"'\s*(OR|AND)\s+1\s*=\s*1",
    r"(SLEEP|WAITFOR\s+DELAY|BENCHMARK)\s*\(",
    r"pg_sleep\s*\(",
    r";\s*(DROP|DELETE|INSERT|UPDATE|CREATE|ALTER)",
]
STRICT_SQL_WORDS = ["DROP", "DELETE", "INSERT", "UPDATE", "ALTER", "CREATE", "TRUNCATE", "EXEC"]
SQL_LANGUAGE_PREFIXES = ["sql", "duckdb"]
PATH_TRAVERSAL_PATTERNS = [
    r"\.\./",
    r"\.\.\\",
    r"%2e%2e[%2f/\\]",
    r"\.\.%2f",
    r"%2e%2e/",
    r"/etc/(passwd|shadow|hosts)",
    r"/proc/self",
    r"C:\\Windows",
    r"\\\\[\w\d]+\\",
]
ARTIFACT_PATTERNS = [
    r"<\|.*?\|>",
    r"\[INST\].*?\[/INST\]",
    r"<<SYS>>.*?<</SYS>>",
    r"###\s*(System|Human|Assistant)\s*:.*?(?=###|$)",
]
PROMPT_FRAGMENTS = [
    "CRITICAL SECURITY RULES",
    "IMMUTABLE",
    "cannot be overridden",
    "━━━",
    "<user_question>",
    "</user_question>",
    "<database_schema>",
    "</database_schema>",
]

# --- Fixed values: recommendation texts ----------------------------------------------

PRIORITY_RANKS = [("critical", 0), ("high", 1), ("medium", 2), ("low", 3)]
PRIORITY_IMPACT = [("critical", 95), ("high", 75), ("medium", 50), ("low", 25)]
CATEGORIES = [
    "compliance", "data_quality", "cash_flow", "vendor",
    "tax_savings", "operational", "risk",
]
ACTIONS = {
    "missing_data": [
        "Review source data for completeness",
        "Implement data validation at entry point",
        "Consider setting default values where appropriate",
    ],
    "critical_issue": [
        "Review the flagged transactions immediately",
        "Consult with tax advisor if needed",
        "File corrections before due date",
    ],
    "deficit": [
        "Accelerate accounts receivable collection",
        "Negotiate extended payment terms with suppliers",
        "Review and defer non-essential expenses",
        "Consider short-term financing options",
    ],
    "vendor_risk": [
        "Identify alternative suppliers for critical items",
        "Conduct vendor performance reviews",
        "Negotiate backup supply agreements",
    ],
    "msme_check": [
        "Request MSME registration certificates from vendors",
        "Update vendor master with MSME flags",
        "Set up payment alerts for MSME vendors",
    ],
}
