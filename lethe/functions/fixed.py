"""Label sets, word lists and patterns that results depend on."""

# Secret and structured personal data patterns, in the order in which they apply.
SECRET_PATTERNS = [
    (r"(?iU)(?<![\w.+%-])[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}(?![\w\-])(?!\.[\w\-])", "EMAIL_ADDRESS"),
    (r"sk-[a-zA-Z0-9\-_]{20,}", "API_KEY"),
    (r"ghp_[a-zA-Z0-9]{36}", "GITHUB_TOKEN"),
    (r"glpat-[a-zA-Z0-9\-_]{20,}", "GITLAB_TOKEN"),
    (r"xox[baprs]-[a-zA-Z0-9\-]+", "SLACK_TOKEN"),
    (r"AKIA[0-9A-Z]{16}", "AWS_KEY"),
    (r"-----BEGIN [A-Z ]+PRIVATE KEY-----", "PRIVATE_KEY"),
    (r"(?iU)password\s*[:=]\s*['\"]?\S{6,}", "PASSWORD"),
    (r"(?iU)secret\s*[:=]\s*['\"]?\S{6,}", "SECRET"),
    (r"(?iU)api[_\-]?key\s*[:=]\s*['\"]?\S{8,}", "API_KEY"),
    (r"(?iU)token\s*[:=]\s*['\"]?\S{8,}", "TOKEN"),
]

# What stands in every match of the pattern at the same place, in lower case where the pattern has no case.
SECRET_LITERALS = dict(zip([p for p, _ in SECRET_PATTERNS], ["@", "sk-", "ghp_", "glpat-", "xox", "AKIA", "-----BEGIN ", "password", "secret", "api", "token"], strict=True))

TOKEN_SHAPE = r"\[(?:[A-Z_]+_\d+_[0-9a-f]{6,}|CATALOG_[A-Z0-9_]+_[0-9a-f]{6,})\]"

# Labels replaced in every mode.
ALWAYS = ["EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD_NUMBER", "SOCIAL_SECURITY_NUMBER", "IBAN", "PASSPORT_NUMBER", "BANK_ACCOUNT_NUMBER", "DATE_OF_BIRTH", "IP_ADDRESS", "API_KEY", "GITHUB_TOKEN", "GITLAB_TOKEN", "SLACK_TOKEN", "AWS_KEY", "PRIVATE_KEY", "PASSWORD", "SECRET", "TOKEN", "SENSITIVE"]
# Labels that the mode decides on.
MODE_AFFECTED = ["PERSON", "ORGANIZATION", "USERNAME", "ADDRESS"]
# Words that name a kind of data and aren't data.
GENERIC_WORDS = ["iban", "ibans", "email", "emails", "email address", "phone", "phones", "phone number", "address", "addresses", "password", "passwords", "api key", "api keys", "token", "tokens", "secret", "secrets", "username", "usernames", "credit card", "credit cards", "ssn", "ssns", "social security number", "ip address", "passport", "name", "names", "person", "organization", "bank account", "date of birth"]
# Least lengths by label; others need two characters.
LEAST_LENGTHS = {"PERSON": 4, "ORGANIZATION": 4, "USERNAME": 4, "IBAN": 10, "CREDIT_CARD_NUMBER": 8, "SOCIAL_SECURITY_NUMBER": 6, "PHONE_NUMBER": 6, "IP_ADDRESS": 7, "BANK_ACCOUNT_NUMBER": 6, "PASSPORT_NUMBER": 5, "API_KEY": 8, "EMAIL_ADDRESS": 5}

# Catalog classification.
EMAIL_CELL = r"(?i)^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$"
PHONE_CELL = r"^\+?[\d\s().-]{7,}$"
ROLE_CATEGORIES = {"email": "EMAIL_ADDRESS", "phone": "PHONE_NUMBER", "mobile": "PHONE_NUMBER", "person": "PERSON", "name": "PERSON", "first_name": "PERSON", "last_name": "PERSON", "address": "ADDRESS", "identifier": "IDENTIFIER"}
STRONG_IDENTIFIER = r"(?i)([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}|\+?[\d\s().-]{7,}|\b(account|customer|iban|vat|bsn|ssn|dob|date of birth|passport|phone|email)\b)"

# Shapes of blacklisted terms, tested in this order.
TERM_EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
TERM_IP = r"^(\d{1,3}\.){3}\d{1,3}$|^[0-9a-fA-F:]+$"
TERM_IBAN = r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$"
TERM_PHONE = r"^\+?[\d\s\-().]{7,}$"

# Shapes that the rule detector finds in text.
RULE_PATTERNS = [
    (r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", "IP_ADDRESS"),
    (r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", "IBAN"),
    (r"(?<!\d)(?:\d{4}[ -]?){3}\d{1,7}(?!\d)", "CREDIT_CARD_NUMBER"),
    (r"(?<![\w.+])\+\d[\d\s().-]{6,}\d", "PHONE_NUMBER"),
]

# Escape marks: a word before ~, and the punctuation that may follow.
ESCAPE = r"(\S{1,128})~([)\]}\"'`.,:;!?]*)(?=\s|$)"
LEFT_PUNCTUATION, RIGHT_PUNCTUATION = "\"'`([{", "\"'`)]}.,:;!?"
LOOK_BACK = 4  # words

# Detector windows, in characters.
WINDOW, OVERLAP, CEILING = 1500, 150, 32_768

# Parent keys whose strings reach a model.
PAYLOAD_TEXT_KEYS = ["arguments", "content", "description", "input", "instructions", "output", "summary", "text"]
