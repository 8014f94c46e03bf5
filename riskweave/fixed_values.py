"""Values that decisions, payloads and prices depend on.

Everything in this file is a fixed value: changing one changes results.
"""

# --- fixed values: rule gate -------------------------------------------------
# Case-insensitive patterns searched in a description. The first one in this
# order that matches is named in the reason.
SANCTIONED_PATTERNS = (
    r"(?i)money\s*launder",
    r"(?i)terrorist",
    r"(?i)sanctions?\s*violation",
    r"(?i)illicit\s*fund",
)

DECISIONS = ("APPROVE", "FLAG", "BLOCK")
APPROVE_SCORE = "10.00"
FLAG_SCORE = "50.00"
BLOCK_SCORE = "95.00"

# --- fixed values: wording of reasons and reasoning --------------------------
SANCTION_REASON = "Sanctioned pattern detected: {pattern}"
VELOCITY_REASON = "High velocity: {count} transactions exceed limit of {limit}"
AMOUNT_REASON = "High amount: {amount} exceeds threshold of {limit}"
DEFAULT_REASON = "No risk indicators detected"
APPROVED_REASONING = "Rule gate: approved"
GATE_REASONING = "Rule gate: {reason}"
ASSESSMENT_REASONING = "LLM: {reasoning}"
HISTORY_REASONING = "History: {count} recent transactions"
SCORE_REASONING = "Weighted score: {score}"
REASONING_SEPARATOR = " | "
HEURISTIC_REASONING = "[Stub] Heuristic: amount-based={amount}, similarity-adj={similarity}, similar-count={count}"
TRANSACTION_TEXT = "{amount} {currency} from {from_account} to {to_account}: {description}"

# --- fixed values: redaction, applied in this order --------------------------
SSN_PATTERN = r"\d{3}-\d{2}-\d{4}"
SSN_MARK = "[REDACTED_SSN]"
EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
EMAIL_MARK = "[REDACTED_EMAIL]"
PHONE_PATTERN = r"(\+?\d{1,3}[\-.\s]?)?\(?\d{3}\)?[\-.\s]?\d{3}[\-.\s]?\d{4}"
PHONE_MARK = "[REDACTED_PHONE]"
PSEUDONYM_HEX_DIGITS = 8

# --- fixed values: formats of valid rows -------------------------------------
ACCOUNT_PATTERN = r"\A[A-Z]{2}[0-9]{10}\z"
PSEUDONYM_PATTERN = r"\A[0-9a-f]{8}\z"
# Full-length UUIDs, and the shorter spelling that leaves out leading zeros.
UUID_PATTERN = r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
SHORT_UUID_PATTERN = r"\A([0-9a-fA-F]{1,15})-([0-9a-fA-F]{1,15})-([0-9a-fA-F]{1,15})-([0-9a-fA-F]{1,15})-([0-9a-fA-F]{1,15})\z"
INSTANT_PATTERN = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?"
    r"([Zz]|[+-][0-9]{2}(:[0-9]{2}(:[0-9]{2})?)?)\z"
)

# A character that trimming leaves.
NOT_BLANK_PATTERN = r"[^\x00-\x20]"

# --- fixed values: ISO 4217 alphabetic codes ---------------------------------
CURRENCY_CODES = tuple(
    """
    AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB
    BOV BRL BSD BTN BWP BYN BZD CAD CDF CHE CHF CHW CLF CLP CNY COP COU CRC CUC
    CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF
    GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF
    KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU
    MUR MVR MWK MXN MXV MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR
    PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN
    SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN UYI UYU UYW
    UZS VED VES VND VUV WST XAF XAG XAU XBA XBB XBC XBD XCD XDR XOF XPD XPF XPT
    XSU XTS XUA XXX YER ZAR ZMW ZWG
    """.split()
)

# Codes that are no longer in use but still name a currency.
HISTORIC_CURRENCY_CODES = tuple(
    """
    ADP AFA ATS AYM AZM BEF BGL BYB BYR CSD CYP DEM EEK ESP FIM FRF GHC GRD GWP
    HRK IEP ITL LTL LUF LVL MGF MRO MTL MZM NLG PTE ROL RUR SDD SIT SKK SLL SRG
    STD TMM TPE TRL USS VEB VEF XFO XFU YUM ZMK ZWD ZWL ZWN ZWR
    """.split()
)

# --- fixed values: events and outbox -----------------------------------------
RECEIVED = "TransactionReceived"
EVALUATED = "TransactionEvaluated"
EVENT_TYPES = (RECEIVED, EVALUATED)
EVENT_TYPE_HEADER = "eventType"
AGGREGATE_TYPE = "Transaction"
TOPIC_PREFIX = "outbox.event."
OUTBOX_RETENTION_DAYS = 7

# --- fixed values: assessment heuristic and history score --------------------
AMOUNT_PER_POINT = 200
MAX_SCORE = 100
NO_NEIGHBOUR_POINTS = "10.00"
SIMILARITY_POINTS = -20.0
NO_HISTORY_SCORE = "60.00"
ZERO_MEAN_SCORE = "50.00"
HISTORY_SLOPE = 30.0
HISTORY_BASE = 30.0

# --- fixed values: vectors ---------------------------------------------------
EMBEDDING_DIMENSIONS = 384
RADIUS = 0.3
RADIUS_LIMIT = 10

# --- fixed values: USD per 1,000 tokens (model, input, output) ---------------
MODEL_PRICES = (
    ("gpt-4o", "0.0025", "0.0100"),
    ("gpt-4o-mini", "0.000150", "0.000600"),
    ("gpt-4-turbo", "0.0100", "0.0300"),
    ("gpt-4", "0.0300", "0.0600"),
    ("gpt-3.5-turbo", "0.0005", "0.0015"),
    ("text-embedding-3-small", "0.00002", "0.0"),
    ("text-embedding-3-large", "0.00013", "0.0"),
)
