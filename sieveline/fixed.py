"""The vocabulary, thresholds, patterns and wordings results depend on.

Everything here is data. Patterns are written in the dialect both DuckDB and the JVM read, with
``\\b``, ``\\w`` and ``\\s`` in their ASCII / Unicode-space sense; ``functions.patterns`` turns them
into the JVM dialect.
"""

from __future__ import annotations

# Scored dimensions, in order, and those that count for each role.
SCORED_DIMS = ["D1", "D2", "D3", "D4", "D5", "D6", "D8", "D9"]
COUNTED_DIMS = {
    "PM": ["D1", "D2", "D3", "D4", "D5", "D6"],
    "SPM": ["D1", "D2", "D3", "D4", "D5", "D6", "D8", "D9"],
}
WEIGHT_DIMS = {
    "PM": ["D1", "D2", "D3", "D4", "D5", "D6", "D7"],
    "SPM": ["D1", "D2", "D3", "D4", "D5", "D6", "D7", "D8", "D9"],
    "CORE": ["D1", "D2", "D3", "D4", "D5", "D6"],
}

# Enum domains.
ROLES_APPLIED = ["PM", "SPM", "NOT_SURE"]
ROLE_TITLES = ["PM", "SPM"]
EVAL_STATUSES = ["queued", "processing", "scored", "needs_review", "failed"]
PIPELINE_STATUSES = ["scored", "advanced", "booked", "interviewed", "offer", "declined", "hold", "withdrawn"]
TIERS = ["A", "B", "C", "D", "R"]
ELIGIBILITIES = ["stated_yes", "stated_no", "unstated"]
ACTIONS = ["advance", "decline", "hold"]
EMAIL_KINDS = ["advance", "decline", "hold", "nudge", "digest"]
EMAIL_STATUSES = ["pending", "scheduled", "sent", "delivered", "bounced", "cancelled", "failed"]
EVIDENCE_STATUSES = ["present", "weak", "absent"]
CONFIDENCES = ["high", "medium", "low"]
ROLE_TYPES = ["PM", "PRODUCT_OWNING", "OTHER", "INTERNSHIP"]
QUALIFIERS = ["built_from_zero", "early_stage_exposure", "senior_pm_layer_above"]

# Default pool configuration.
DEFAULT_CONFIG = {
    "weights": {
        "PM": {"D1": 20, "D2": 15, "D3": 15, "D4": 15, "D5": 15, "D6": 5, "D7": 15},
        "SPM": {"D1": 20, "D2": 10, "D3": 15, "D4": 10, "D5": 5, "D6": 10, "D7": 5, "D8": 15, "D9": 10},
        "CORE": {"D1": 30, "D2": 20, "D3": 15, "D4": 15, "D5": 10, "D6": 10},
    },
    "tiers": {"A": 70, "B": 55, "C": 40},
    "d1GateForTierA": False,
    "pmExperienceFloorYears": 1,
    "spmExperienceFloorYears": 4,
    "experienceBandStrict": False,
    "runsPerCv": 3,
    "unstableSpread": 2,
    "holdDefaultDays": 21,
    "sendDelayMinutes": {"advance": 10, "hold": 10, "decline": 1440},
    "nudgeAfterDays": 3,
    "retentionDays": 180,
    "offerTargetDate": "2026-12-31",
}

# Limits.
MIN_WORDS = 150
MIN_COVERAGE = 0.6
MAX_FILE_BYTES = 10 * 1024 * 1024
LEASE_SECONDS = 360
STUCK_MINUTES = 10
MAX_ATTEMPTS = 3
MAX_TRANSIENT_RETRIES = 8
BACKOFF_FIRST_SECONDS = 30
BACKOFF_MAX_SECONDS = 900
RETRY_SECONDS = 60
BETTER_FIT_POINTS = 10
SHINGLE_WORDS = 8
MAX_EVIDENCE = 3
LOCAL_ZONE = "Asia/Kolkata"

# Flags that ranking sets; every other flag survives a re-rank.
RANK_FLAGS = [
    "WILDCARD", "VERIFY_CLAIM", "QUOTE_MISMATCH", "UNSTABLE_SCORE", "BELOW_EXPERIENCE_BAND",
    "CONSIDER_SPM", "CONSIDER_PM", "LEVEL_CHECK",
]

# Delivery-event types, statuses and their order.
EVENT_STATUS = {
    "email.sent": "sent", "email.delivered": "delivered", "email.bounced": "bounced", "email.failed": "failed",
}
STATUS_RANK = {"pending": 0, "scheduled": 1, "sent": 2, "delivered": 3, "bounced": 4, "failed": 4, "cancelled": 4}
PROVIDER_STATUS = {
    "delivered": "delivered", "opened": "delivered", "clicked": "delivered", "complained": "delivered",
    "bounced": "bounced", "failed": "failed", "suppressed": "failed",
}

# Pipeline table order, and the allowed moves as (move, from) pairs.
PIPELINE_ORDER = ["offer", "interviewed", "booked", "advanced", "hold", "scored", "declined", "withdrawn"]
ACTION_STATUS = {"advance": "advanced", "decline": "declined", "hold": "hold"}
DECISION_MOVES = {
    "advance": ["scored", "hold"],
    "hold": ["scored", "hold"],
    "decline": ["scored", "hold", "advanced", "booked", "interviewed"],
}
STATUS_MOVES = {
    "booked": ["advanced"],
    "interviewed": ["booked"],
    "offer": ["interviewed"],
    "withdrawn": ["advanced", "booked", "interviewed"],
}

# Lines that try to instruct a reader model, in order; the first match names the line.
INJECTION_PATTERNS = [
    ("ignore_instructions", r"\b(ignore|disregard|forget)\b.{0,40}\b(instructions?|prompts?|rules?|rubric)\b"),
    ("you_are_ai", r"\byou are (now )?(an?|the)( [\w-]+){0,2} (ai|assistant|language model|llm|model|chatbot|recruiter bot|screener)\b"),
    ("score_me", r"\b(score|rate|rank|grade)\s+(this|me|this candidate|this cv|this resume)\b"),
    ("rating_demand", r"\b\d{1,3}\s*/\s*(10|100)\b.{0,30}\b(score|rating|candidate)\b|\b(score|rate|rating)\b.{0,30}\b(10\s*/\s*10|100\s*/\s*100)\b"),
    ("system_prompt", r"\bsystem\s+prompt\b|\bdeveloper\s+(message|instructions?)\b"),
    ("role_tags", r"</?\s*(system|assistant|instructions?|profile|cv_text|rubric)\s*>"),
    ("hire_directive", r"\b(must|should)\s+(be\s+)?(hired|shortlisted|advanced|selected)\b|\b(shortlist|hire|advance)\s+(this|me)\b"),
]

# Contact patterns. The phone pattern asks for ten digits or more.
EMAIL_PATTERN = r"[\w.+%-]+@[\w-]+(\.[\w-]+)+"
URL_PATTERN = r"\b(https?://\S+|www\.\S+|(?:[\w-]+\.)+(?:com|in|io|me|org|net|dev|co|ai|app)/\S*)"
PHONE_PATTERN = r"(?<![\w₹$€£])\+?\d(?:[\s\-().]*\d){9,}(?![\w%])"

# Date patterns.
MONTH_PATTERN = (
    "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|"
    "Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?|JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|SEPT|OCT|NOV|DEC)"
)
YEAR_PATTERN = r"(?:19[5-9]\d|20[0-3]\d)"
NOT_A_COUNT_PATTERN = (
    r"(?![%\d]|\s*\+|\s+(?:employees|staff|people|members|engineers|clients|customers|users|merchants|"
    r"shipments|containers|orders|accounts|units|stores|trucks|vehicles|SKUs|tickets)\b)"
)
DATE_PATTERNS = [
    rf"\b{MONTH_PATTERN}\.?,?\s*(?:{YEAR_PATTERN}|'\d{{2}})\b",
    r"\b\d{1,2}[/.-]\d{1,2}[/.-](?:\d{4}|\d{2})\b",
    rf"\b{YEAR_PATTERN}[/-](?:0?[1-9]|1[0-2])\b(?![/-]\d)",
    rf"\b(?:0?[1-9]|1[0-2])/{YEAR_PATTERN}\b",
    r"\bFY\s?'?\d{2}(?:\d{2})?(?:\s*[-–/]\s*'?\d{2,4})?\b",
    rf"(?<![₹$€£#\d.,])\b{YEAR_PATTERN}(?:\s*[-–]\s*\d{{2}})?\b{NOT_A_COUNT_PATTERN}",
]
LEAK_MONTH_YEAR_PATTERN = (
    r"\b(Jan(uary)?|Feb(ruary)?|Mar(ch)?|Apr(il)?|May|June?|July?|Aug(ust)?|Sep(t(ember)?)?|Oct(ober)?|"
    rf"Nov(ember)?|Dec(ember)?)\.?,?\s*{YEAR_PATTERN}\b"
)
LEAK_YEAR_PATTERN = rf"(?<![₹$€£#\d.,])\b{YEAR_PATTERN}\b{NOT_A_COUNT_PATTERN}"
LEAK_GENDERED_PATTERN = r"\b(he|she|him|her|his|hers|himself|herself)\b"
LEAK_HONORIFIC_PATTERN = r"\b(Mr|Mrs|Ms|Miss|Smt|Shri)\b\.?(?=\s)"

# Honorifics and pronouns. A pronoun rule is (words, what follows, replacement).
HONORIFIC_PREFIX = r"\b(?:Mr|Mrs|Ms|Miss|Mx|Shri|Smt|Dr)\.?\s+"
HONORIFIC_NAME = r"\p{Lu}[\p{L}'-]+(?:\s+\p{Lu}[\p{L}'-]+)?"
HONORIFIC_BARE = r"\b(?:Mr|Mrs|Ms|Mx)\.?(?=\s|$)"
PRONOUN_RULES = [
    (["he's", "she's"], r"\b", "they're"),
    (["himself", "herself"], r"\b", "themself"),
    (["hers"], r"\b", "theirs"),
    (["he", "she"], r"\b", "they"),
    (["her"], r"(?=\s+\p{L})", "their"),
    (["him", "her"], r"\b", "them"),
    (["his"], r"\b", "their"),
]

# Academic scores and honours (only the phrase goes).
ACADEMIC_PATTERNS = [
    r"\b(C?GPA|CPI|SGPA)\s*[:\-]?\s*\d+(\.\d+)?(\s*/\s*\d+(\.\d+)?)?",
    r"\b\d{2}(\.\d+)?\s*%\s*(marks|aggregate|percentile)\b",
    r"\b(gold|silver|bronze)\s+medal(l)?ist\b[^·|;,.\n]*",
    r"\buniversity (rank|topper)\b[^·|;,.\n]*",
    r"\b(first class( with distinction)?|first division|second class|dean'?s list|summa cum laude|magna cum laude|cum laude)\b",
    r"\b(AIR|all india rank|rank)\s*[:#]?\s*\d+\b",
]

# Whole units that go: breaks, personal details, relocation, languages.
GAP_PATTERNS = [
    r"\bcareer[- ](break|gap|pause|restart|returner)\b", r"\bsabbatical\b", r"\bmaternity\b", r"\bpaternity\b",
    r"\bparental leave\b", r"\bgap year\b", r"\b(took|taking|take) (a |some )?(break|time off|time out)\b",
    r"\bbreak (in|from) (my )?(career|work|employment)\b", r"\breturn(ed|ing)? to (work|the workforce)\b",
    r"\b(caregiving|care-giving|caring for (my|a|an|their) )",
    r"\bfamily (reasons|commitments|responsibilities|emergency)\b", r"\bmedical (leave|reasons)\b",
    r"\b(employment|career) gap\b",
]
PERSONAL_PATTERNS = [
    r"\bdate of birth\b", r"\bborn (on|in)\b", r"\bage\s*[:\-]\s*\d", r"\b\d{2}\s*(years|yrs) old\b",
    r"\bmarital status\b", r"\b(married|unmarried|divorced|widowed)\b", r"\bnationality\b", r"\breligion\b",
    r"\bcaste\b", r"\bgender\s*[:\-]", r"\bsex\s*[:\-]", r"\b(father|mother|husband|wife|spouse)'?s? name\b",
    r"\bpassport\s*(no|number|#)", r"\bnative place\b", r"\bhometown\b", r"\bpermanent address\b",
]
PERSONAL_CASED_PATTERN = r"\bD\.?O\.?B\.?\b"
RELOCATION_PATTERN = (
    r"\b(willing|unwilling|open|happy|able|unable|ready|keen|prepared|not|cannot|can't|won't)\b.{0,25}"
    r"\b(relocat\w*|move|moving)\b|\b(no|open to) relocation\b|"
    r"\brelocation (is )?(not )?(possible|an option|preferred)\b|\bnotice period\b"
)
LANGUAGE_SENTENCE_PATTERN = (
    r"\b(fluent|fluency|proficient|proficiency|speak|speaks|spoken|native speaker|mother tongue|languages?)\b"
)
LANGUAGE_PREFIX_PATTERN = r"^\s*(?:spoken\s+)?languages?(?:\s+(?:known|spoken))?\s*[:-]\s*"
NOT_A_COMPANY_PATTERN = r"^(self[- ]?employed|independent|freelance|freelancer|consultant|various|confidential)$"

# Relocation eligibility.
ELIGIBLE_NO_PATTERN = (
    r"\b(not|unwilling|unable|cannot|can't|won't|no)\b.{0,25}\b(relocat\w*|move|moving)\b|\bno relocation\b"
)
ELIGIBLE_YES_PATTERN = (
    r"\b(willing|open|happy|ready|able|keen|plan(ning)?)\b.{0,20}\b(to )?(relocat\w*|move)\b|"
    r"\brelocating to mumbai\b|\bmumbai[- ]based\b|\bbased in mumbai\b"
)
ELIGIBLE_PLACE_PATTERN = r"\b(mumbai|bombay|navi mumbai|thane)\b"

# Topics a brief must not touch.
BRIEF_FORBIDDEN_PATTERN = (
    r"\b(career break|break in|gap (in|between) (employment|jobs|roles)|employment gap|sabbatical|maternity|"
    r"paternity|family|married|children|kids|age|old are you|born|location|relocat\w*|move to mumbai|health|"
    r"medical|salary|compensation|ctc|pay|college|university|school|caste|religion|gender|pregnan\w*)\b"
)
INVITE_FORBIDDEN_PATTERN = (
    r"\b(score|scored|scoring|rubric|ai|artificial intelligence|algorithm|rank|ranked|ranking|tier|"
    r"shortlist(ed)?|automated|model)\b"
)

# Role-type rates for experience, and the half-open years bands per role.
ROLE_TYPE_RATE = {"PM": 1.0, "PRODUCT_OWNING": 0.5, "OTHER": 0.0, "INTERNSHIP": 0.0}
YEARS_BANDS = {"PM": [1.5, 2, 4, 6], "SPM": [4, 5, 8, 10]}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
PRESENT_PATTERN = r"(?i)^(present|current|now|till date|to date|ongoing|today)$"
CAPPED_SECTIONS = ["SUMMARY", "SKILLS", "EDUCATION"]

# Wordings.
DIM_NAMES = {
    "D1": "Ground-level operations exposure",
    "D2": "Self-initiated problem solving, adopted by others",
    "D3": "Ownership without structure",
    "D4": "Shipped, killed, learned",
    "D5": "Customer-outcome orientation and discovery",
    "D6": "Owns the recovery when things break",
    "D7": "Experience fit (role band)",
    "D8": "Platform, integration and data-layer depth",
    "D9": "Building the product function",
}
FLAG_TEXT = {
    "WILDCARD": "Strong operator-builder outside logistics: listed beside Tier A. Tier unchanged.",
    "INTEGRITY_CHECK": "Hidden text, injected instructions or rubric-like phrasing was found and removed. Genuine content was still scored.",
    "VERIFY_CLAIM": "At least one dimension scored 4. A verification probe is included.",
    "QUOTE_MISMATCH": "The AI quoted text that is not in the CV; that dimension was set to 0.",
    "NO_CONTACT": "No email address on the CV: this candidate can't be emailed.",
    "LEGACY": "Applied before this system existed. Emails open with an apology.",
    "BOUNCED": "An email to this candidate bounced.",
    "UNSTABLE_SCORE": "The three scoring runs disagreed by 2 or more on a dimension. Please read the CV.",
    "BELOW_EXPERIENCE_BAND": "PM-relevant experience is below the floor for this role.",
    "CONSIDER_SPM": "Applied for PM but has more than 5 years of PM-relevant experience and strong ownership: consider for Senior PM.",
    "CONSIDER_PM": "Applied for Senior PM with under 4 years of PM-relevant experience: consider for PM.",
    "LEVEL_CHECK": "Over 10 years of PM-relevant experience: may expect a Head of Product role.",
}
TIER_REASON_TEXT = {
    "unparseable": "Too little readable text (under 150 words) or the file could not be read.",
    "extraction_fidelity": "The AI's split of the CV did not match the original text, even after a retry.",
    "redaction_leak": "Identity details could not be fully removed, so the AI was not given this CV.",
    "invalid_output": "The AI's output was invalid after retries.",
    "unparseable_dates": "The dates of a PM or product-owning role could not be read, so experience can't be computed.",
    "unstable_score": "The three scoring runs disagreed too much.",
    "quote_mismatch": "Three or more dimensions had quotes not found in the CV.",
    "absent_evidence": "Three or more dimensions have no evidence in the CV (a thin CV is never a decline).",
    "insufficient_evidence": "Total below 40 without enough evidence to recommend a decline.",
    "capped_pm_experience_floor": "Capped at B: under the PM experience floor.",
    "capped_spm_experience_floor": "Capped at B: under the Senior PM experience floor.",
    "capped_experience_band": "Capped at B: outside the experience band (strict mode).",
    "capped_d1_gate": "Capped at B: D1 below 2 (D1 gate is on).",
}
ROLE_TITLE_TEXT = {"PM": "Product Manager", "SPM": "Senior Product Manager"}

# The digest's lines.
DIGEST_LEAD = ("Holds due today: decide again on ", ".\n\n")
DIGEST_WAITING = ("- Waiting for your decision: ", "{n_waiting}", " (oldest ", "{oldest_days}", " days): ", "{url}", "/shortlist\n")
DIGEST_LISTS = {
    "holds_due": "- Holds due today: ",
    "interviewed": "- Interviewed, no next step: ",
    "not_booked": "- Advanced, not booked (nudged): ",
    "bounced": "- Bounced emails: ",
}
DIGEST_PIPELINE = (
    "- Pipeline: Advanced ", "{n_advanced}", " · Booked ", "{n_booked}", " · Interviewed ", "{n_interviewed}", " · Offer ", "{n_offer}",
)

# Subject and paragraphs of each letter. A paragraph with an empty field is left out.
LETTERS = {
    "advance": (
        "Next step: {title} at {company}",
        [
            "Hi {first_name},",
            "{opening}Thanks for applying for the {title} role at {company}.{invite}",
            "I'd like to set up a conversation. Please pick a time that works for you here: {booking_url}",
            "{ask}",
            "Looking forward to it,\n{signature}",
            "{footer}",
        ],
    ),
    "decline": (
        "Your application for {title} at {company}",
        [
            "Hi {first_name},",
            "{opening}Thank you for taking the time to apply for the {title} role at {company}. We've reviewed your application carefully "
            "and have decided not to move forward with it for this role.",
            "We appreciate your interest in {company} and wish you the very best in your search.",
            "{signature}",
            "{footer}",
        ],
    ),
    "hold": (
        "Update on your application: {title} at {company}",
        [
            "Hi {first_name},",
            "{opening}Thank you for applying for the {title} role. We're still reviewing applications and will get back to you by {hold_until}.",
            "{signature}",
            "{footer}",
        ],
    ),
    "nudge": (
        "Re: Next step: {title} at {company}",
        [
            "Hi {first_name}, just checking this reached you. If you'd still like to talk, you can pick a time here: {booking_url}. {short_name}",
            "{footer}",
        ],
    ),
}
# The note on a bullet used too often, and the rationale of a quote that isn't in the document.
REUSE_NOTE = ("Evidence bullet ", " already supports ", " and ", "; a bullet may support at most 2 dimensions.")
QUOTE_NOT_FOUND = "Quote not found in the CV; scored 0."
# What tidies a text after redaction, in this order.
TIDY_PATTERNS = [
    (r"[ \t]{2,}", " "),
    (r"\s+([,.;:)])", "$1"),
    (r"\(\s*\)", ""),
    (r"\s*[·|,](?:\s*[·|,])+\s*", " · "),
    (r"^[\s·|,]+|[\s·|,]+$", ""),
]
